"""Image files: listing, decoding, descriptors, hashes, duplicates, forest, scoring."""

import json
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrank import sources
from lumenrank.operators import fingerprints, learning, scoring
from lumenrank.plans import duplicate_report, train_forest_from_images
from png import write_png


@pytest.fixture(scope="module")
def library(tmp_path_factory):
    root = tmp_path_factory.mktemp("lib")
    rng = np.random.default_rng(0)
    for tier in range(6):
        if tier == 4:
            continue
        for i in range(4):
            base = rng.integers(0, 256, size=(4, 4, 3))
            smooth = np.kron(base, np.ones((6, 6, 1)))
            noise = rng.normal(scale=4 * tier, size=smooth.shape)
            write_png(root / f"quality_{tier}" / f"img{i}.png", np.clip(smooth + noise, 0, 255))
    base = np.kron(rng.integers(0, 250, size=(8, 8, 1)), np.ones((4, 4, 3)))
    write_png(root / "copies" / "a.png", base)
    write_png(root / "copies" / "b.PNG", base)
    write_png(root / "copies" / "c.png", base + 1)
    (root / "copies" / "broken.png").write_bytes(b"no")
    (root / "copies" / "notes.txt").write_text("x")
    (root / "quality_0" / "deep").mkdir()
    write_png(root / "quality_0" / "deep" / "img9.png", base)
    write_png(root / ".git" / "x.png", base)
    return root


def names(df):
    return sorted(r.name for r in df.collect())


def test_listing(spark, library):
    assert names(sources.scan_items(spark, str(library / "copies"))) == ["a.png", "b.PNG", "broken.png", "c.png"]
    assert names(sources.scan_items(spark, str(library / "copies" / "a.png"))) == ["a.png"]
    assert names(sources.scan_items(spark, str(library / "copies"), extensions=[".TXT"])) == ["notes.txt"]
    everything = sources.scan_items(spark, str(library), recursive=True)
    assert everything.count() == 25  # Spark itself skips folders that start with a dot
    assert sources.scan_items(spark, str(library), recursive=True, prune_dirs=True).count() == 25


def test_listing_does_not_read_content(spark, library):
    df = sources.scan_items(spark, str(library), recursive=True)
    assert "content" not in df._jdf.queryExecution().executedPlan().toString()


def test_empty_folder(spark, tmp_path):
    assert sources.scan_items(spark, str(tmp_path)).count() == 0


def test_unreadable_image_becomes_an_error_row(spark, library):
    good, bad = sources.split_readable(sources.scan_images(spark, str(library / "copies")))
    assert good.count() == 3
    assert [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["broken.png"]


def test_labels_and_missing_classes(spark, library):
    items = sources.scan_items(spark, str(library), recursive=True)
    labelled = sources.labels_from_folders(items)
    assert labelled.count() == 20  # the nested file is not directly inside its folder
    missing = learning.check_classes(labelled).collect()
    assert [r.tier for r in missing] == [4]
    with pytest.raises(ValueError, match="Qualité 4"):
        learning.check_classes(labelled, strict=True)


def reference_descriptors(gray):
    h, w = gray.shape
    at = lambda y, x: gray[abs(y) if y < h else 2 * h - 2 - y, abs(x) if x < w else 2 * w - 2 - x]
    lap = np.array([[at(y - 1, x) + at(y + 1, x) + at(y, x - 1) + at(y, x + 1) - 4 * at(y, x) for x in range(w)] for y in range(h)])
    weights = {-1: 1, 0: 2, 1: 1}
    gx = np.array([[sum(weights[d] * (at(y + d, x + 1) - at(y + d, x - 1)) for d in weights) for x in range(w)] for y in range(h)])
    gy = np.array([[sum(weights[d] * (at(y + 1, x + d) - at(y - 1, x + d)) for d in weights) for x in range(w)] for y in range(h)])
    hist = np.array([(gray == v).sum() for v in range(256)], dtype=float)
    p = hist / hist.sum()
    return [lap.var(), gray.std(), gray.mean(), hist.mean(), hist.std(), (gx**2 + gy**2).mean(), -(p * np.log2(p + 1e-10)).sum()]


def test_descriptors_of_a_colour_image(spark, tmp_path):
    rgb = np.random.default_rng(4).integers(0, 256, size=(9, 7, 3))
    write_png(tmp_path / "x.png", rgb)
    good, _ = sources.split_readable(sources.scan_images(spark, str(tmp_path)))
    r = fingerprints.image_descriptors(good).first()
    gray = np.floor(0.299 * rgb[:, :, 0] + 0.587 * rgb[:, :, 1] + 0.114 * rgb[:, :, 2] + 0.5)
    assert [r[d] for d in fingerprints.DESCRIPTORS] == pytest.approx(reference_descriptors(gray))


def test_phash_sizes(spark, library):
    good, _ = sources.split_readable(sources.scan_images(spark, str(library / "copies")))
    small = {r.item_id[-5:]: r.h for r in fingerprints.phash(good).collect()}
    assert small["a.png"] == small["b.PNG"] == small["c.png"]
    large = fingerprints.phash(good, hash_size=16).first()
    assert len(large.h) == 4


def test_area_weights_average():
    w = fingerprints._area_weights(2, 5)
    assert w == pytest.approx(np.array([[0.4, 0.4, 0.2, 0, 0], [0, 0, 0.2, 0.4, 0.4]]))
    assert fingerprints._area_weights(4, 2) == pytest.approx(np.repeat(np.eye(2), 2, axis=0))


def test_duplicate_report(spark, library):
    images = sources.scan_images(spark, str(library / "copies"))
    _, plan = duplicate_report(images, threshold=5)
    got = sorted((r.dest_dir, r.dest_name) for r in plan.collect())
    assert got == [("groupe_001", "00_a.png"), ("groupe_001", "01_b.PNG"), ("groupe_001", "02_c.png")]


def test_forest_is_saved_and_reloaded(spark, library, tmp_path):
    images = sources.scan_images(spark, str(library))
    model, metrics = train_forest_from_images(images, numTrees=5)
    assert metrics.first().mse >= 0
    sources.write_ml_model(model, str(tmp_path / "model"))
    good, _ = sources.split_readable(images)
    rows = fingerprints.image_descriptors(good)
    before = learning.predict_quality_forest(model, rows).collect()
    after = learning.predict_quality_forest(sources.load_ml_model(str(tmp_path / "model")), rows).collect()
    assert before == after
    scores = [r.predicted_quality for r in before]
    assert scores == sorted(scores, reverse=True) and all(0 <= s <= 5 for s in scores)


def test_split_share(spark):
    parts = learning.split_train_test(spark.range(5000).withColumnRenamed("id", "item_id"), 0.3)
    share = parts.filter("split = 'test'").count() / 5000
    assert abs(share - 0.3) < 0.03


def test_scoring_calls_the_model_in_batches(spark):
    items = spark.range(250).select(F.col("id").alias("item_id"), F.col("id").cast("double").alias("x")).coalesce(1)

    def make_predict():
        return lambda batch: [[float(len(batch))] for _ in batch]

    sizes = scoring.score_batches(items, make_predict, "x").groupBy("output").count().collect()
    assert {r.output[0]: r["count"] for r in sizes} == {100.0: 200, 50.0: 50}


def test_scoring_isolates_failures(spark):
    items = spark.range(10).select(F.col("id").alias("item_id"), F.col("id").cast("double").alias("x"))

    def make_predict():
        def predict(batch):
            if 3.0 in batch:
                raise KeyError("three")
            return [[x] for x in batch]

        return predict

    rows = scoring.scalar_scores(scoring.score_batches(items, make_predict, "x")).collect()
    failed = [r for r in rows if not r.success]
    assert len(rows) == 10 and [r.item_id for r in failed] == [3]
    assert "KeyError" in failed[0].error and failed[0].score is None


def test_vote_state_file(spark, tmp_path):
    state = {
        "method": "condorcet", "raw_scores": {"/a/x.jpg": 3.1, "/a/y.jpg": 2.9}, "scores": {"/a/x.jpg": 3.1, "/a/y.jpg": 2.9},
        "comparisons_count": 1, "max_comparisons": 100, "is_normalized": False,
        "comparisons": [{"timestamp": "2024-01-01T00:00:00", "image1": "x.jpg", "image2": "y.jpg", "winner": "x.jpg",
                         "score1_before": 3.0, "score2_before": 3.0, "score1_after": 3.1, "score2_after": 2.9}],
        "current_pair": ["/a/x.jpg", "/a/y.jpg"],
    }
    (tmp_path / "state.json").write_text(json.dumps(state, indent=2))
    saved = {r.name: (r.raw_score, r.score) for r in sources.read_vote_state(spark, str(tmp_path)).collect()}
    assert saved == {"x.jpg": (3.1, 3.1), "y.jpg": (2.9, 2.9)}
    d = sources.read_duel_log(spark, str(tmp_path)).first()
    assert (d.seq, d.winner, d.loser) == (1, "x.jpg", "y.jpg")


def test_prediction_csv_with_float_tiers(spark, tmp_path):
    (tmp_path / "p.csv").write_text(
        "image_path,predicted_quality,quality_label,confidence,success,error\n"
        "/a.jpg,3.0,Correcte,0.7,True,\n/b.jpg,,,,False,broken\n"
    )
    rows = {r.image_path: r for r in sources.read_predictions(spark, str(tmp_path / "p.csv")).collect()}
    assert rows["/a.jpg"].predicted_quality == 3 and rows["/a.jpg"].success
    assert rows["/b.jpg"].predicted_quality is None and rows["/b.jpg"].error == "broken"
    with pytest.raises(ValueError, match="quality_label"):
        (tmp_path / "q.csv").write_text("image_path\n/a.jpg\n")
        sources.read_predictions(spark, str(tmp_path / "q.csv"))


def test_annotation_files_with_unlike_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,image_path,label,class_name\n2024-01-01T00:00:00,/a.jpg,3,x\n")
    (tmp_path / "b c.csv").write_text("label,image_path,class_name\n4,/b.jpg,y\n5,/c.jpg,z\n")
    got = {(r.image_path, r.label, r.class_name) for r in sources.read_annotations(spark, str(tmp_path)).collect()}
    assert got == {("/a.jpg", 3, "x"), ("/b.jpg", 4, "y"), ("/c.jpg", 5, "z")}
    (tmp_path / "d.csv").write_text("image_path\n/d.jpg\n")
    with pytest.raises(ValueError, match="label"):
        sources.read_annotations(spark, str(tmp_path))


def test_vote_state_with_partial_scores(spark, tmp_path):
    state = {"method": "elo", "raw_scores": {"x": 1.5, "y": None}, "scores": {"x": 5.0, "z": 1.0}, "comparisons_count": 0}
    (tmp_path / "s.json").write_text(json.dumps(state))
    (tmp_path / "t.json").write_text(json.dumps({**state, "raw_scores": {"w": 2.0}, "scores": None}))
    rows = sources.read_vote_state(spark, str(tmp_path)).collect()
    assert {(r.item, r.raw_score, r.score) for r in rows} == {("x", 1.5, 5.0), ("y", None, None), ("w", 2.0, None)}


def test_manifest_runs_the_model_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def make_predict():
        def predict(values):
            (calls / uuid.uuid4().hex).write_text(str(len(values)))
            return [[1.0, 2.0, 0.5, 0.1, 0.2, 0.3] for _ in values]

        return predict

    items = spark.range(30).select(F.col("id").cast("string").alias("item_id"), F.col("id").alias("x"))
    scored = scoring.class_predictions(scoring.score_batches(items, make_predict, "x")).withColumnRenamed("item_id", "image_path")
    sources.write_predictions(scored, str(tmp_path / "out"), "json")
    row = spark.read.json(str(tmp_path / "out" / "manifest")).first()
    assert (row.total_images, row.successful_predictions) == (30, 30)
    assert sum(int(p.read_text()) for p in calls.iterdir()) == 30  # counted outside the workers, which are reused
