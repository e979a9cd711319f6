"""Near-duplicate groups and density clusters on top of the similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenrank.operators.cosine import build_index, core_links, distinct_vectors, neighbour_counts
from lumenrank.operators.hamming import distinct_values, value_pairs
from lumenrank.operators.positions import with_position
from lumenrank.session import Rounds, materialise


# ---------------------------------------------------------------- leader groups


def _leaders_along_chains(single: DataFrame, roots: DataFrame) -> DataFrame:
    """``ord_a`` of the leaders among nodes with one open earlier neighbour, ``node, ptr``, that hang from the leaders ``roots``.

    Such a node leads exactly if its neighbour doesn't, so along a chain of
    them leaders and members alternate. Pointers are doubled: a chain of n
    takes log n joins.
    """
    path, rounds = materialise(single.withColumn("flips", F.lit(1)), "chains"), Rounds("chains")
    while not path.join(single.select(F.col("node").alias("ptr")), "ptr", "left_semi").isEmpty():
        beyond = path.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), F.col("flips").alias("more"))
        path = rounds.save(
            path.join(beyond, "ptr", "left").select(
                "node", F.coalesce("next", "ptr").alias("ptr"), ((F.col("flips") + F.coalesce("more", F.lit(0))) % 2).alias("flips")
            )
        )
    return path.filter("flips = 0").join(roots.withColumnRenamed("ord_a", "ptr"), "ptr", "left_semi").select(F.col("node").alias("ord_a"))


def lead_members(edges: DataFrame) -> DataFrame:
    """Owner of every claimed node, ``ord, leader`` for edges ``ord_a < ord_b``.

    In scan order a node becomes a leader unless an earlier leader is within
    reach. The rounds decide all nodes whose earlier neighbours are settled:
    those without an undecided earlier neighbour lead, and so does every second
    node of the chains that hang from them; their neighbours are claimed, and
    edges of settled nodes are dropped. The result is that of the sequential
    scan.
    """
    edges = materialise(edges.select("ord_a", "ord_b"), "edges")
    open_edges, claimed, rounds = edges, None, Rounds("open-edges")
    while not open_edges.isEmpty():
        earlier = open_edges.groupBy("ord_b").agg(F.count(F.lit(1)).alias("n"), F.min("ord_a").alias("ptr"))
        earlier = materialise(earlier.select(F.col("ord_b").alias("node"), "n", "ptr"), "earlier")
        roots = open_edges.select("ord_a").distinct().join(earlier.select(F.col("node").alias("ord_a")), "ord_a", "left_anti")
        chained = _leaders_along_chains(earlier.filter("n = 1").select("node", "ptr"), roots)
        leaders = materialise(roots.unionByName(chained), "leaders")
        now = materialise(
            open_edges.join(leaders, "ord_a", "left_semi").select(F.col("ord_b").alias("ord")).distinct(), "claimed"
        )
        claimed = now if claimed is None else claimed.unionByName(now)
        settled = leaders.select(F.col("ord_a").alias("ord")).unionByName(now)
        open_edges = rounds.save(
            open_edges.join(settled.withColumnRenamed("ord", "ord_a"), "ord_a", "left_anti").join(
                now.withColumnRenamed("ord", "ord_b"), "ord_b", "left_anti"
            )
        )
    if claimed is None:
        return edges.select(F.col("ord_b").alias("ord"), F.col("ord_a").alias("leader")).filter(F.lit(False))
    from_leaders = edges.join(claimed.withColumnRenamed("ord", "ord_a"), "ord_a", "left_anti")
    to_members = from_leaders.join(claimed.withColumnRenamed("ord", "ord_b"), "ord_b", "left_semi")
    return to_members.groupBy(F.col("ord_b").alias("ord")).agg(F.min("ord_a").alias("leader"))


def leader_groups(
    items: DataFrame, threshold: int = 5, item: str = "item_id", order: str = "ord", h: str = "h"
) -> DataFrame:
    """Near-duplicate groups of two or more: ``item_id, ord, leader_ord, group_no, member_pos``.

    Star-shaped, not transitive: each member is within ``threshold`` bits of
    its leader. Group numbers follow the leaders' order, the leader is member 0.
    """
    rows = items.select(F.col(item).alias("item_id"), F.col(order).alias("ord"), F.col(h).alias("h"))
    values = materialise(distinct_values(rows, "ord", "h"), "values")
    owner = lead_members(value_pairs(values, threshold))
    owned = values.join(owner, "ord", "left").select(
        "h", "n_copies", F.coalesce("leader", "ord").alias("leader_ord")
    )
    sizes = owned.groupBy("leader_ord").agg(F.sum("n_copies").alias("n")).filter("n > 1")
    numbered = with_position(sizes.select("leader_ord"), ["leader_ord"], name="group_no", start=1)
    kept = owned.join(numbered, "leader_ord").select("h", "leader_ord", "group_no")
    return with_position(rows.join(kept, "h").drop("h"), ["ord"], ["group_no"], "member_pos")


def similar_items(items: DataFrame, threshold: int = 5, item: str = "item_id", order: str = "ord", h: str = "h") -> DataFrame:
    """Similar pairs of distinct fingerprints with the copies behind each side."""
    rows = items.select(F.col(item).alias("item_id"), F.col(order).alias("ord"), F.col(h).alias("h"))
    values = materialise(distinct_values(rows, "ord", "h"), "values")
    side = values.select("ord", "n_copies")
    pairs = value_pairs(values, threshold)
    a = side.select(F.col("ord").alias("ord_a"), F.col("n_copies").alias("copies_a"))
    b = side.select(F.col("ord").alias("ord_b"), F.col("n_copies").alias("copies_b"))
    return pairs.join(a, "ord_a").join(b, "ord_b").select("ord_a", "ord_b", "distance", "copies_a", "copies_b")


# ---------------------------------------------------------------- connected components


def _is_flat(stars: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    parents = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    nested = stars.join(parents.select(F.col("u").alias("v")), "v", "left_semi").select("u")
    return parents.filter("n > 1").select("u").unionByName(nested).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``ord, component`` for every node of the edges; component = its smallest node.

    Alternates the large-star and small-star contractions of Kiveris et al.
    (2014) until every edge points at a root. Both only take minima per node,
    which combine map-side, so a hub with a third of all edges is never
    gathered.
    """
    rounds = Rounds("stars")
    current = rounds.save(
        edges.select(F.greatest("ord_a", "ord_b").alias("u"), F.least("ord_a", "ord_b").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )
    while not _is_flat(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        moved = small.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        current = rounds.save(moved.unionByName(own).distinct())
    members = current.select(F.col("u").alias("ord"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("ord"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)


# ---------------------------------------------------------------- density clusters


def density_clusters(
    vectors: DataFrame,
    eps: float = 0.5,
    min_samples: int = 2,
    item: str = "item_id",
    order: str = "ord",
    features: str = "features",
    cell_size: int = 4096,
    tile: int = 2048,
) -> DataFrame:
    """Density clusters under cosine distance: ``item_id, ord, cluster``; -1 is noise.

    A core item has ``min_samples`` items (itself included) within ``eps``;
    connected cores form a cluster, numbered by its first core; a border item
    joins the smallest cluster among its core neighbours. No list of near pairs
    is written: tiles give neighbour counts, then one link per core and the few
    links of border items.
    """
    rows = vectors.select(F.col(item).alias("item_id"), F.col(order).alias("ord"), F.col(features).alias("features"))
    values = materialise(distinct_vectors(rows).withColumn("mark", F.col("n_copies")), "values")
    # zero vectors have no direction: each one is its own only neighbour
    zeros = rows.filter(~F.exists("features", lambda x: x != 0)).select("ord", F.lit(1).cast("bigint").alias("n_copies"))
    if eps >= 1 and not zeros.isEmpty():
        raise ValueError("with eps of 1 or more a zero vector would be near every item; remove zero vectors first")
    nodes = values.select("ord", "n_copies").unionByName(zeros)
    n = values.count()
    index = build_index(values, n, cell_size) if n else None
    around = neighbour_counts(index, eps, tile) if n else nodes.select("ord", F.lit(0).alias("near"))
    degree = nodes.join(around, "ord", "left").select(
        "ord", (F.col("n_copies") + F.coalesce("near", F.lit(0)) >= min_samples).alias("core")
    )
    degree = materialise(degree, "degree")
    core = degree.filter("core").select("ord")
    links = core_links(index, degree, eps, tile) if n else degree.select(F.col("ord").alias("ord_a"), F.col("ord").alias("ord_b"), "core").limit(0)
    links = materialise(links, "links")
    component = core.join(connected_components(links.filter("core")), "ord", "left").select(
        "ord", F.coalesce("component", "ord").alias("first_core")
    )
    component = materialise(component, "components")
    numbers = with_position(component.select("first_core").distinct(), ["first_core"], name="cluster")
    core_label = component.join(numbers, "first_core").select("ord", "cluster")
    border = (
        links.filter("NOT core").join(core_label.withColumnRenamed("ord", "ord_b"), "ord_b")
        .groupBy(F.col("ord_a").alias("ord")).agg(F.min("cluster").alias("cluster"))
    )
    labelled = core_label.unionByName(border)
    ids = rows.select("item_id", "ord")
    if values.filter("n_copies > 1").isEmpty():
        label = ids.join(labelled, "ord", "left")
    else:
        # copies take the label of their vector; only repeated vectors are joined back
        repeated = values.filter("n_copies > 1").select("features", F.col("ord").alias("first"))
        later = rows.join(repeated, "features").filter("ord <> first").select("ord", "first")
        first = ids.join(later, "ord", "left").withColumn("first", F.coalesce("first", "ord"))
        label = first.join(labelled.withColumnRenamed("ord", "first"), "first", "left")
    return label.select("item_id", "ord", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"))
