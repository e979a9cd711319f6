"""Layout plans against a sequential simulation of the target folders."""

import random

import pytest

from lumenrank.operators import layout, positions

ROWS = "row_num bigint, src_path string, dest_dir string, name string"


def simulate(rows, existing):
    taken, out = set(existing), {}
    for n, _, d, name in sorted(rows):
        stem, dot, ext = name.rpartition(".")
        dest, k = name, 0
        while (d, dest) in taken:
            k += 1
            dest = f"{stem}_{k}{dot}{ext}"
        taken.add((d, dest))
        out[n] = dest
    return out


def run(spark, rows, existing):
    df = spark.createDataFrame(rows, ROWS)
    seed = spark.createDataFrame(existing, "dest_dir string, name string")
    return {r.row_num: r.dest_name for r in layout.resolve_names(df, seed).collect()}


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_the_sequential_walk(spark, seed, monkeypatch):
    if seed % 2:  # positions by range partitions, as on large tables
        monkeypatch.setattr(positions.with_position, "__defaults__", ((), "pos", 0, 0))
    rng = random.Random(seed)
    stems = ["p", "p_1", "p_2", "p_3", "p_1_1", "p_1_2", "p_2_1", "q", "q_7", "p_01", "p_0"]
    rows = [(i, f"/in/{i}", rng.choice("AB"), rng.choice(stems[: 5 + seed * 2]) + ".jpg") for i in range(120)]
    existing = sorted({(rng.choice("AB"), rng.choice(stems) + ".jpg") for _ in range(seed * 3)})
    assert run(spark, rows, existing) == simulate(rows, existing)


def test_one_name_for_most_rows(spark):
    rows = [(i, f"/in/{i}", "A", "photo.jpg" if i % 5 else f"photo_{i}.jpg") for i in range(600)]
    assert run(spark, rows, []) == simulate(rows, [])


def test_generated_name_meets_a_literal_one(spark):
    rows = [(1, "a", "d", "photo.jpg"), (2, "b", "d", "photo.jpg"), (3, "c", "d", "photo_1.jpg")]
    assert run(spark, rows, []) == {1: "photo.jpg", 2: "photo_1.jpg", 3: "photo_1_1.jpg"}


def test_moving_takes_a_source_once(spark):
    rows = spark.createDataFrame(
        [(2, " /in/a.jpg ", "x"), (3, "/in/a.jpg", "y"), (4, "/in/gone.jpg", "x")], "row_num bigint, path string, dir string"
    )
    listing = spark.createDataFrame([("/in/a.jpg",)], "path string")
    got = {r.row_num: (r.dest_dir, r.dest_name, r.status) for r in layout.layout_from_mapping(rows, listing, mode="move").collect()}
    assert got == {
        2: ("x", "a.jpg", "ok"), 3: ("y", None, "source moved"), 4: ("x", None, "source not found"),
    }
    copied = layout.layout_from_mapping(rows, listing).filter("status = 'ok'").count()
    assert copied == 2


def test_tier_layout_options(spark):
    rows = spark.createDataFrame(
        [(1, "/a/x.jpg", 3.0), (2, "/b/x.jpg", 3.0), (3, "/c/y.jpg", 3.47)], "item_id bigint, image_path string, predicted_quality double"
    )
    strict = {r.row_num: (r.dest_dir, r.dest_name) for r in layout.layout_by_tier(rows).collect()}
    assert strict == {1: ("3_Good", "x.jpg"), 2: ("3_Good", "x_1.jpg"), 3: ("Unknown_Quality", "y.jpg")}
    rounded = {r.row_num: r.dest_dir for r in layout.layout_by_tier(rows, rounding=True).collect()}
    assert rounded[3] == "3_Good"
    listing = spark.createDataFrame([("/b/x.jpg",)], "path string")
    assert [r.row_num for r in layout.layout_by_tier(rows, "overwrite", listing=listing).collect()] == [2]


def test_cluster_layout(spark):
    df = spark.createDataFrame([(1, "/a/x.jpg", -1), (2, "/a/y.jpg", 4)], "item_id bigint, path string, cluster int")
    assert {r.dest_dir for r in layout.layout_by_cluster(df).collect()} == {"noise", "cluster_4"}
    assert {r.dest_dir for r in layout.layout_by_cluster(df, handle_noise=False).collect()} == {"cluster_-1", "cluster_4"}
