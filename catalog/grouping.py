"""Fingerprints, similarity joins, near-duplicate groups, density clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived, query
from lumenrank.operators import aggregates, cosine, fingerprints, grouping, hamming
from lumenrank.plans import semantic_grouping

EPS = 0.62


@query("select item_id, hi, lo from simhash", uses="simhash")
def text_fingerprints(spark, sf):
    hashed = fingerprints.text_fingerprint(derived.table(spark, sf, "documents"))
    return hashed.select(
        F.col("doc_id").alias("item_id"),
        F.shiftrightunsigned("h", 32).alias("hi"),
        F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
    )


@query(
    """select item_id, min(item_id) over (partition by hi, lo) rep_ord from simhash""", uses="simhash"
)
def fingerprint_copies(spark, sf):
    """Every item with the first item of the same fingerprint."""
    return hamming.copies(derived.simhash(spark, sf)).select("item_id", "rep_ord")


@query("select ord_a, ord_b, distance from pairs3", uses="pairs3")
def hamming_pairs(spark, sf):
    """Pairs of distinct fingerprints within 3 bits."""
    return hamming.hamming_pairs(derived.simhash(spark, sf), 3)


@query("select ord_a, ord_b, distance from pairs3", uses="pairs3")
def hamming_pairs_tiled(spark, sf):
    """The same join with large keys cut into tiles."""
    return hamming.hamming_pairs(derived.simhash(spark, sf), 3, bands=5, tile=2)


@query("select ord_a, ord_b, distance, na copies_a, nb copies_b from pairs3", uses="pairs3")
def similar_pairs(spark, sf):
    """Similar fingerprints with the number of copies behind each side."""
    return grouping.similar_items(derived.simhash(spark, sf), 3)


_WALK = """with recursive v as (select ord, n_copies, row_number() over (order by ord) i from values),
 nb as (select v.i, v.ord, v.n_copies, coalesce(list(p.ord_a) filter (where p.ord_a is not null), []) earlier
  from v left join pairs3 p on p.ord_b = v.ord group by all),
 w(i, leaders, ord, leader, n_copies) as (
  select 0::bigint, []::bigint[], null::bigint, null::bigint, 0::bigint
  union all
  select nb.i, case when list_has_any(w.leaders, nb.earlier) then w.leaders else list_append(w.leaders, nb.ord) end, nb.ord,
   case when list_has_any(w.leaders, nb.earlier) then list_min(list_intersect(w.leaders, nb.earlier)) else nb.ord end, nb.n_copies
  from w join nb on nb.i = w.i + 1),
 m as (select s.item_id, w.leader leader_ord from w join values v2 on v2.ord = w.ord join simhash s on s.hi = v2.hi and s.lo = v2.lo where w.ord is not null),
 k as (select *, count(*) over (partition by leader_ord) c from m),
 g as (select item_id, leader_ord, dense_rank() over (order by leader_ord) group_no, row_number() over (partition by leader_ord order by item_id) - 1 member_pos from k where c > 1)"""


@query(_WALK + " select item_id, leader_ord, group_no, member_pos from g", uses="pairs3")
def near_duplicate_groups(spark, sf):
    """Leader groups of the documents' fingerprints within 3 bits."""
    return grouping.leader_groups(derived.simhash(spark, sf), 3).select("item_id", "leader_ord", "group_no", "member_pos")


@query(_WALK + " select leader_ord, count(*) n from g group by 1", uses="pairs3")
def groups_of_two_or_more(spark, sf):
    return aggregates.groups_of_two_or_more(grouping.leader_groups(derived.simhash(spark, sf), 3), "leader_ord")


_COSINE = f"""
 with recursive e as (select vec_id, embedding::double[] v from embeddings),
 p as materialized (select a.vec_id a, b.vec_id b, list_cosine_distance(a.v, b.v) d from e a join e b on a.vec_id < b.vec_id and list_cosine_distance(a.v, b.v) <= {EPS})"""


@query(_COSINE + " select a ord_a, b ord_b, round(d, 6) distance from p")
def cosine_pairs(spark, sf):
    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("features"))
    return cosine.cosine_pairs(vectors, EPS).withColumn("distance", F.round("distance", 6))


@query(_COSINE + " select a ord_a, b ord_b, round(d, 6) distance from p")
def cosine_pairs_in_cells(spark, sf):
    """The same join with many pivots and small tiles."""
    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("features"))
    return cosine.cosine_pairs(vectors, EPS, cell_size=64, tile=50).withColumn("distance", F.round("distance", 6))


def _clusters_sql(min_samples: int) -> str:
    return _COSINE + f""",
 s as (select a, b from p union all select b, a from p),
 dg as (select vec_id, 1 + count(s.b) deg from e left join s on s.a = vec_id group by 1),
 core as (select vec_id from dg where deg >= {min_samples}),
 reach(a, b) as (select vec_id, vec_id from core union select r.a, s.b from reach r join s on s.a = r.b join core on core.vec_id = s.b),
 comp as (select a vec_id, min(b) first_core from reach group by 1),
 num as (select first_core, row_number() over (order by first_core) - 1 c from (select distinct first_core from comp)),
 lab as (select vec_id, c from comp join num using (first_core)),
 border as (select s.a vec_id, min(lab.c) c from s join lab on lab.vec_id = s.b where s.a not in (select vec_id from core) group by 1),
 k as (select e.vec_id item_id, coalesce(lab.c, border.c, -1)::int as cluster from e left join lab using (vec_id) left join border using (vec_id))"""


def _vectors(spark, sf):
    return derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("vec_id").alias("ord"),
        F.col("embedding").alias("features"),
        F.format_string("/lib/set%d/img_%d.png", "label", "vec_id").alias("path"),
    )


@query(_clusters_sql(2) + " select item_id, cluster from k")
def density_clusters(spark, sf):
    return grouping.density_clusters(_vectors(spark, sf), EPS, 2).select("item_id", "cluster")


@query(_clusters_sql(3) + " select item_id, cluster from k")
def density_clusters_with_border(spark, sf):
    return grouping.density_clusters(_vectors(spark, sf), EPS, 3).select("item_id", "cluster")


@query(
    _clusters_sql(2) + """, z as (select cluster, count(*) size from k group by 1)
 select count(*) filter (where cluster <> -1) n_clusters, coalesce(sum(size) filter (where cluster = -1), 0)::bigint n_noise,
 coalesce(sum(size) filter (where cluster <> -1), 0)::bigint n_clustered, max(size) filter (where cluster <> -1) largest from z"""
)
def semantic_grouping_report(spark, sf):
    """Vectors -> clusters -> statistics."""
    return semantic_grouping(_vectors(spark, sf), EPS, 2)[2]


@query(
    _clusters_sql(2) + """ select k.item_id, concat('/lib/set', label, '/img_', vec_id, '.png') src_path,
 case when cluster = -1 then 'noise' else 'cluster_' || cluster end dest_dir, concat('img_', vec_id, '.png') dest_name
 from k join embeddings on vec_id = k.item_id"""
)
def semantic_layout(spark, sf):
    """Vectors -> clusters -> one folder per cluster."""
    return semantic_grouping(_vectors(spark, sf), EPS, 2)[1]


@query(
    _clusters_sql(2) + " select cluster, count(*) size from k group by 1"
)
def cluster_sizes(spark, sf):
    return aggregates.cluster_sizes(grouping.density_clusters(_vectors(spark, sf), EPS, 2))


_GRID = """with recursive g as (select item_id, y, x, gray::double g from grid),
 s as (select item_id, y, x, g,
  coalesce(lag(g) over r, lead(g) over r) l, coalesce(lead(g) over r, lag(g) over r) rr,
  coalesce(lag(g) over c, lead(g) over c) u, coalesce(lead(g) over c, lag(g) over c) d
  from g window r as (partition by item_id, y order by x), c as (partition by item_id, x order by y)),
 t as (select *, rr - l ax, l + 2*g + rr sm from s),
 z as (select item_id, g, l + rr + u + d - 4*g lap,
  coalesce(lag(ax) over c, lead(ax) over c) + 2*ax + coalesce(lead(ax) over c, lag(ax) over c) gx,
  coalesce(lead(sm) over c, lag(sm) over c) - coalesce(lag(sm) over c, lead(sm) over c) gy
  from t window c as (partition by item_id, x order by y)),
 h as (select item_id, g, count(*)::double c from z group by 1, 2),
 hh as (select item_id, sum(c) n, sqrt(sum(c*c)/256 - pow(sum(c)/256, 2)) hist_std, sum(c)/256 hist_mean from h group by 1),
 en as (select item_id, -sum(c/n * log2(c/n + 1e-10)) entropy from h join hh using (item_id) group by 1),
 f as (select item_id, avg(lap*lap) - pow(avg(lap), 2) laplacian_var, sqrt(avg(g*g) - pow(avg(g), 2)) contrast, avg(g) brightness, avg(gx*gx + gy*gy) sobel_mean from z group by 1)
 select item_id, round(laplacian_var, 4) laplacian_var, round(contrast, 4) contrast, round(brightness, 4) brightness, round(hist_mean, 4) hist_mean,
  round(hist_std, 4) hist_std, round(sobel_mean, 4) sobel_mean, round(entropy, 4) entropy from f join hh using (item_id) join en using (item_id)"""


def _rounded(df):
    return df.select("item_id", *[F.round(c, 4).alias(c) for c in fingerprints.DESCRIPTORS])


@query(_GRID, uses="grid")
def grid_descriptors(spark, sf):
    """Seven quality descriptors of grids held as rows."""
    return _rounded(fingerprints.grid_descriptors(derived.grid(spark, sf)))


def _images(spark, sf):
    return fingerprints.grid_images(derived.table(spark, sf, "embeddings"), "vec_id", "embedding", 8)


@query(_GRID, uses="grid")
def image_descriptors(spark, sf):
    """The same descriptors from decoded images."""
    return _rounded(fingerprints.image_descriptors(_images(spark, sf), item="item_id"))


# each source row of an 8-row picture covers four of the 32 target rows
_PHASH = """with b as (select u.i u, s.i p, sum(2 * cos(pi() * u.i * (2 * (4*s.i + o.i) + 1) / 64)) w from range(0,8) u(i), range(0,8) s(i), range(0,4) o(i) group by 1, 2),
 rowsum as (select item_id, x, b.u, sum(gray * w) v from grid join b on b.p = y group by 1, 2, 3),
 f as (select item_id, r.u, b.u v, sum(r.v * w) c from rowsum r join b on b.p = x group by 1, 2, 3),
 m as (select item_id, median(c) md from f group by 1)
 select item_id, sum(case when c > md then (case when u*8+v = 63 then -9223372036854775808::hugeint else (1::bigint << (u*8+v)::int)::hugeint end) else 0 end)::bigint h
 from f join m using (item_id) group by 1"""


@query(_PHASH, uses="grid")
def perceptual_hash(spark, sf):
    return fingerprints.phash(_images(spark, sf), item="item_id")
