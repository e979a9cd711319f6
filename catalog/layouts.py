"""Layout plans and name conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived, query
from catalog.grouping import _WALK
from lumenrank.operators import filters, grouping, layout


@query(
    """with p as (select item_id row_num, image_path src_path, coalesce(['0_VeryPoor','1_Poor','2_Medium','3_Good','4_VeryGood','5_Excellent'][predicted_quality+1], 'Unknown_Quality') dest_dir,
  parse_filename(image_path) as name from predictions)
 select row_num, src_path, dest_dir, name dest_name from p""",
    uses="predictions",
)
def tier_layout(spark, sf):
    return layout.layout_by_tier(derived.predictions(spark, sf))


@query(
    """with p as (select doc_id, case n_chars % 8 when 0 then '0_VeryPoor' when 1 then '1_Poor' when 2 then '2_Medium' when 3 then '3_Good' when 4 then '4_VeryGood'
  when 5 then '5_Excellent' else 'Unknown_Quality' end dest_dir, lang || '.jpg' as name, '/in/' || source || '/' || lang || '.jpg' src_path from documents)
 select max(doc_id) row_num, arg_max(src_path, doc_id) src_path, dest_dir, name dest_name from p group by dest_dir, name"""
)
def tier_layout_overwriting(spark, sf):
    """Equal names in a folder: the last row stays."""
    rows = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.lit("/in/"), "source", F.lit("/"), "lang", F.lit(".jpg")).alias("image_path"),
        (F.col("n_chars") % 8).alias("predicted_quality"),
    )
    return layout.layout_by_tier(rows, on_conflict="overwrite")


_TARGET = """ok as (select m.row_num, m.path src_path, m.dir, parse_filename(m.path) as name,
  row_number() over (partition by m.dir order by m.row_num) i from mapping m where m.path in (select path from listing)),
 seed as (select dir, coalesce(list(name) filter (where name is not null), []) taken from (select distinct dir from ok)
  left join ({existing}) x using (dir) group by 1),
 w(dir, i, taken, row_num, src_path, dest_name) as (
  select dir, 0::bigint, taken, null::bigint, null::varchar, null::varchar from seed
  union all
  select dir, i, list_append(taken, dest), row_num, src_path, dest from (
   select w.dir, ok.i, w.taken, ok.row_num, ok.src_path,
    case when not list_contains(w.taken, ok.name) then ok.name else
     replace(ok.name, '.jpg', '') || '_' || list_filter(range(1, len(w.taken) + 2), lambda k: not list_contains(w.taken, replace(ok.name, '.jpg', '') || '_' || k || '.jpg'))[1] || '.jpg' end dest
   from w join ok on ok.dir = w.dir and ok.i = w.i + 1))"""

_NO_EXISTING = "select null::varchar dir, null::varchar as name where false"
_EXISTING = "select distinct source dir, lang || case when toxic = 1 then '_2' else '' end || '.jpg' as name from documents join labels using (doc_id) where quality = 1"
_RESULT = """ select row_num, src_path, dir dest_dir, dest_name, 'ok' status from w where i > 0
 union all select row_num, path, dir, null, 'source not found' from mapping where path not in (select path from listing)"""


@query("with recursive " + _TARGET.format(existing=_NO_EXISTING) + _RESULT, uses="mapping listing")
def mapping_layout(spark, sf):
    """Mapping rows to free names per folder; missing sources become error rows."""
    rows = derived.mapping(spark, sf)
    return layout.layout_from_mapping(rows, derived.listing(spark, sf))


@query("with recursive " + _TARGET.format(existing=_EXISTING) + _RESULT, uses="mapping listing")
def mapping_layout_into_filled_folders(spark, sf):
    """The same into folders that already hold files."""
    labelled = derived.table(spark, sf, "documents").join(
        derived.table(spark, sf, "labels").filter("quality = 1"), "doc_id"
    )
    suffix = F.when(F.col("toxic") == 1, F.lit("_2")).otherwise(F.lit(""))
    existing = labelled.select(
        F.col("source").alias("dest_dir"), F.concat("lang", suffix, F.lit(".jpg")).alias("name")
    ).distinct()
    return layout.layout_from_mapping(derived.mapping(spark, sf), derived.listing(spark, sf), existing)


@query(
    """with m as (select row_num, '/in/' || lang || '.jpg' path, dir from mapping join documents on doc_id = row_num - 2)
 select row_num, path src_path, dir dest_dir, case when row_num = min(row_num) over (partition by path) then replace(path, '/in/', '') end dest_name,
 case when row_num = min(row_num) over (partition by path) then 'ok' else 'source moved' end status from m""",
    uses="mapping",
)
def mapping_layout_moving(spark, sf):
    """Moving: a source is gone after its first row."""
    docs = derived.table(spark, sf, "documents").select((F.col("doc_id") + 2).alias("row_num"), "lang")
    rows = derived.mapping(spark, sf).select("row_num", "dir").join(docs, "row_num").select(
        "row_num", F.concat(F.lit("/in/"), "lang", F.lit(".jpg")).alias("path"), "dir"
    )
    return layout.layout_from_mapping(rows, rows.select("path").distinct(), mode="move")


@query("select path, m.row_num from mapping m where path in (select path from listing)", uses="mapping listing")
def existing_sources(spark, sf):
    """Rows whose source is in the listing."""
    found, _ = filters.split_by_existence(derived.mapping(spark, sf), derived.listing(spark, sf))
    return found.select("path", "row_num")


@query(
    _WALK + """ select item_id, '/lib/' || d.lang || '_' || item_id || '.jpg' src_path, 'groupe_' || lpad(group_no::varchar, greatest(3, len(group_no::varchar))::int, '0') dest_dir,
 lpad(member_pos::varchar, greatest(2, len(member_pos::varchar))::int, '0') || '_' || d.lang || '_' || item_id || '.jpg' dest_name from g join documents d on d.doc_id = g.item_id""",
    uses="pairs3",
)
def near_duplicate_layout(spark, sf):
    """One folder per near-duplicate group, members numbered."""
    groups = grouping.leader_groups(derived.simhash(spark, sf), 3)
    paths = derived.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.concat(F.lit("/lib/"), "lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"),
    )
    return layout.layout_by_dup_group(groups, paths)
