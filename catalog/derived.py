"""Tables derived from the given ones, built by Spark and, as SQL, by the checker."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank.operators.fingerprints import gray_grid, text_fingerprint
from lumenrank.operators.positions import with_position
from lumenrank.operators.scoring import class_predictions
from lumenrank.session import materialise

_written: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def once(name: str) -> Callable:
    """Write a derived table once per application and data folder."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(build)
        def get(spark: SparkSession, sf: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _written:
                _written[key] = materialise(build(spark, sf), name)
            return _written[key]

        return get

    return wrap


# ---------------------------------------------------------------- predictions

SQL = {}

SQL["predictions"] = """
 with l as (select vec_id, label, list_max(embedding)::double > 0.38 bad,
   list_transform(range(0, 6), lambda i: list_sum(list_transform(list_filter(embedding, lambda x, j: (j - 1) % 6 = i), lambda x: x::double*10))) lg
  from embeddings),
 e as (select *, list_transform(lg, lambda x: exp(x - list_max(lg))) ex from l),
 p as (select *, list_transform(ex, lambda x: x / list_sum(ex)) pr from e)
 select vec_id item_id, concat('/lib/set', label, '/img_', vec_id, '.png') image_path, not bad success,
  cast(case when not bad then list_position(pr, list_max(pr)) - 1 end as int) predicted_quality,
  case when not bad then list_max(pr) end confidence,
  case when not bad then pr end all_probabilities,
  case when not bad then ['Tres mauvaise','Mauvaise','Mediocre','Correcte','Bonne','Excellente'][list_position(pr, list_max(pr))] end quality_label,
  case when bad then 'ValueError: value out of range' end error,
  cast(label % 6 as int) truth from p"""

OUT_OF_RANGE = 0.38


def folded(n: int) -> Column:
    """The whole vector as ``n`` outputs: sums of ten times the components at every n-th place."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.aggregate(F.filter("embedding", lambda x, j: j % n == i), F.lit(0.0), lambda total, x: total + x.cast("double") * 10),
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """Model outputs: the vector folded into six logits; vectors out of range count as failures."""
    ok = F.array_max("embedding").cast("double") <= OUT_OF_RANGE
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.format_string("/lib/set%d/img_%d.png", "label", "vec_id").alias("image_path"),
        ok.alias("success"),
        F.when(~ok, F.lit("ValueError: value out of range")).alias("error"),
        F.when(ok, folded(6)).alias("output"),
        (F.col("label") % 6).cast("int").alias("truth"),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return class_predictions(logits(spark, sf))


SQL["ratings10"] = """
 with l as (select vec_id, list_transform(range(0, 10), lambda i:
   exp(list_sum(list_transform(list_filter(embedding, lambda x, j: (j - 1) % 10 = i), lambda x: x::double*10)))) ex from embeddings)
 select vec_id item_id, list_transform(ex, lambda x: x/list_sum(ex)) probs from l"""


def ratings10(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), fn.softmax(folded(10)).alias("probs"))


# ---------------------------------------------------------------- votes

SQL["duels"] = """
 with o as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 rn from events),
 p as (select a.user_id session_id, a.rn k, a.event_type ea, b.event_type eb, a.value va, b.value vb
  from o a join o b on a.user_id = b.user_id and b.rn = a.rn + 1 and a.rn % 2 = 0
  where a.event_type <> b.event_type and a.value <> b.value)
 select session_id, cast(row_number() over (partition by session_id order by k) as bigint) seq,
  case when va > vb then ea else eb end winner, case when va > vb then eb else ea end loser from p"""


@once("duels")
def duels(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive events of a user as duels; the larger value wins."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    placed = with_position(events, ["ts", "event_id"], ["user_id"], "rn")
    second = F.col("rn") % 2 == 1
    side = F.struct("value", "event_type")
    pairs = (
        placed.groupBy(F.col("user_id").alias("session_id"), F.floor(F.col("rn") / 2).alias("k"))
        .agg(F.max(F.when(~second, side)).alias("a"), F.max(F.when(second, side)).alias("b"))
        .filter((F.col("a.event_type") != F.col("b.event_type")) & (F.col("a.value") != F.col("b.value")))
    )
    a_wins = F.col("a.value") > F.col("b.value")
    played = pairs.select(
        "session_id",
        "k",
        F.when(a_wins, F.col("a.event_type")).otherwise(F.col("b.event_type")).alias("winner"),
        F.when(a_wins, F.col("b.event_type")).otherwise(F.col("a.event_type")).alias("loser"),
    )
    return with_position(played, ["k"], ["session_id"], "seq", start=1).select("session_id", "seq", "winner", "loser")


SQL["players"] = "select distinct user_id session_id, event_type item from events"


def players(spark: SparkSession, sf: str) -> DataFrame:
    """Items of every session, duelled or not."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_type").alias("item")
    ).distinct()


def elo_sql(source: str) -> str:
    return f"""
 with recursive w(session_id, seq, st) as (
  select distinct session_id, 0::bigint, map([]::varchar[], []::double[]) from {source}
  union all
  select w.session_id, d.seq, map_concat(w.st, map([d.winner, d.loser], [
    coalesce(w.st[d.winner], 0.0) + 32*(1 - 1/(1+pow(10.0, (coalesce(w.st[d.loser],0.0)-coalesce(w.st[d.winner],0.0))/400.0))),
    coalesce(w.st[d.loser], 0.0) - 32*(1 - 1/(1+pow(10.0, (coalesce(w.st[d.loser],0.0)-coalesce(w.st[d.winner],0.0))/400.0)))]))
  from w join {source} d on d.session_id = w.session_id and d.seq = w.seq + 1),
 f as (select session_id, unnest(map_entries(arg_max(st, seq))) kv from w group by session_id)
 select session_id, kv.key item, kv.value raw_score from f"""


SQL["elo"] = elo_sql("duels")

SQL["bounded_walk"] = """
 with recursive w(session_id, seq, st, winner, loser, wb, lb, wa, la) as (
  select distinct session_id, 0::bigint, map([]::varchar[], []::int[]), null::varchar, null::varchar, 0, 0, 0, 0 from duels
  union all
  select w.session_id, d.seq, map_concat(w.st, map([d.winner, d.loser], [
    least(50, coalesce(w.st[d.winner], 30) + 1), greatest(0, coalesce(w.st[d.loser], 30) - 1)])),
   d.winner, d.loser, coalesce(w.st[d.winner], 30), coalesce(w.st[d.loser], 30),
   least(50, coalesce(w.st[d.winner], 30) + 1), greatest(0, coalesce(w.st[d.loser], 30) - 1)
  from w join duels d on d.session_id = w.session_id and d.seq = w.seq + 1)
 select * from w"""

SQL["bounded"] = """
 with f as (select session_id, unnest(map_entries(arg_max(st, seq))) kv from bounded_walk group by session_id)
 select session_id, kv.key item, kv.value / 10.0::double raw_score, kv.value / 10.0::double score from f"""

SQL["elo_scored"] = """
 select e.session_id, e.item, e.raw_score, case when hi = lo then 2.5 else round(5.0 * (raw_score - lo) / (hi - lo), 3) end score
 from elo e join (select session_id, min(raw_score) lo, max(raw_score) hi from elo group by 1) b using (session_id)"""

# ---------------------------------------------------------------- libraries of paths

SQL["paths"] = """
 select doc_id, concat('/lib/', source, case when n_chars % 7 = 0 then '/.git' when n_chars % 11 = 0 then '/.venv' when n_chars % 5 = 0 then '/.github' else '' end,
  '/quality_', n_chars % 8, '/', lang, n_chars % 13, '_', doc_id, '.',
  ['jpg','JPG','jpeg','png','bmp','gif','tiff','webp','txt'][n_chars % 9 + 1]) path from documents"""


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """File paths of an imagined library, one per document."""
    n = F.col("n_chars")
    hidden = (
        F.when(n % 7 == 0, F.lit("/.git")).when(n % 11 == 0, F.lit("/.venv")).when(n % 5 == 0, F.lit("/.github"))
    ).otherwise(F.lit(""))
    exts = F.array(*[F.lit(e) for e in ("jpg", "JPG", "jpeg", "png", "bmp", "gif", "tiff", "webp", "txt")])
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(
            F.lit("/lib/"), "source", hidden, F.lit("/quality_"), (n % 8).cast("string"), F.lit("/"), "lang",
            (n % 13).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."),
            F.get(exts, (n % 9).cast("int")),
        ).alias("path"),
    )


SQL["mapping"] = """
 select cast(row_number() over (order by doc_id) + 1 as bigint) row_num,
  concat('/in/', doc_id, '/', lang, case when n_chars % 3 = 0 then '' else concat('_', doc_id % 37) end, '.jpg') path, source dir
 from documents"""


@once("mapping")
def mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Mapping rows whose names clash with each other and with numbered names."""
    number = F.when(F.col("n_chars") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("_"), (F.col("doc_id") % 37).cast("string"))
    )
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("/"), "lang", number, F.lit(".jpg")).alias("path"),
        F.col("source").alias("dir"),
    )
    return with_position(rows, ["doc_id"], name="row_num", start=2).select("row_num", "path", "dir")


SQL["listing"] = """
 select distinct concat('/in/', doc_id, '/', lang, case when n_chars % 3 = 0 then '' else concat('_', doc_id % 37) end, '.jpg') path
 from documents join labels using (doc_id)"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Source files that exist: those of labelled documents."""
    known = table(spark, sf, "labels").select(F.concat(F.lit("/in/"), F.col("doc_id").cast("string")).alias("folder"))
    return (
        mapping(spark, sf)
        .withColumn("folder", fn.dirname(F.col("path")))
        .join(known, "folder", "left_semi")
        .select("path")
        .distinct()
    )


# ---------------------------------------------------------------- fingerprints and grids

SQL["simhash"] = """
 with t as (select doc_id, md5(tok) m from (select doc_id, unnest(regexp_extract_all(lower(text),'[\\p{L}\\p{M}\\p{N}]+')) tok from documents)),
 h as (select doc_id, ('0x'||substr(m,1,8))::bigint hi, ('0x'||substr(m,9,8))::bigint lo, count(*) n from t group by 1,2,3),
 g as (select doc_id, b, sum(case when (hi >> b) & 1 = 1 then n else -n end) shi, sum(case when (lo >> b) & 1 = 1 then n else -n end) slo
  from h, range(0,32) z(b) group by 1,2)
 select doc_id item_id, sum(case when shi>0 then 1::bigint << b else 0 end)::bigint hi,
  sum(case when slo>0 then 1::bigint << b else 0 end)::bigint lo from g group by 1"""


@once("simhash")
def simhash(spark: SparkSession, sf: str) -> DataFrame:
    hashed = text_fingerprint(table(spark, sf, "documents"))
    return hashed.select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("ord"), "h")


SQL["values"] = """select hi, lo, min(item_id) ord, count(*) n_copies from simhash group by 1, 2"""

SQL["pairs3"] = """
 select least(a.ord, b.ord) ord_a, greatest(a.ord, b.ord) ord_b,
  cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as int) distance, a.n_copies na, b.n_copies nb
 from values a join values b on a.ord < b.ord and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3"""

SQL["grid"] = """
 select vec_id item_id, cast((i-1)//8 as int) y, cast((i-1)%8 as int) x,
  cast(least(255, greatest(0, floor(embedding[i]::double*256 + 128))) as int) gray from embeddings, range(1,65) r(i)"""


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return gray_grid(table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


SQL["annotation_log"] = """
 select doc_id item_id, quality label, timestamp '2024-01-01 00:00:00' + doc_id * interval 1 second ts, 2 * doc_id row_num from labels
 union all
 select doc_id, 1 - quality, timestamp '2024-02-01 00:00:00' + doc_id * interval 1 second, 2 * doc_id + 1 from labels where toxic = 0"""


JANUARY, FEBRUARY = 1704067200, 1706745600  # 2024-01-01 and 2024-02-01 UTC


def annotation_log(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as a log in which clean items were labelled again later."""
    rows = table(spark, sf, "labels")

    def at(start: int):
        return F.timestamp_seconds(F.lit(start) + F.col("doc_id"))

    first = rows.select(
        F.col("doc_id").alias("item_id"), F.col("quality").alias("label"), at(JANUARY).alias("ts"),
        (2 * F.col("doc_id")).alias("row_num"),
    )
    again = rows.filter("toxic = 0").select(
        F.col("doc_id").alias("item_id"), (1 - F.col("quality")).alias("label"), at(FEBRUARY).alias("ts"),
        (2 * F.col("doc_id") + 1).alias("row_num"),
    )
    return first.unionByName(again)


# ---------------------------------------------------------------- SQL assembly

_NEEDS = {
    "elo": ["duels"], "elo_scored": ["elo"], "bounded_walk": ["duels"], "bounded": ["bounded_walk"],
    "values": ["simhash"], "pairs3": ["values"],
}


def with_tables(names: list[str], sql: str) -> str:
    """Prefix ``sql`` with the definitions of the derived tables it names."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in _NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return sql.strip()
    ctes = ",\n".join(f"{name} as materialized ({SQL[name].strip()})" for name in order)
    body = sql.strip()
    if body.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{body[len('with recursive '):]}"
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[len('with '):]}"
    return f"with {ctes}\n{body}"
