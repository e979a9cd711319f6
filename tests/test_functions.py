"""Edge values of scalar functions, tiers and summaries."""

import math

import pytest
from pyspark.sql import functions as F

from lumenrank import functions as fn
from lumenrank import schemas, sources
from lumenrank.operators import aggregates, filters, metrics, positions
from lumenrank.tiers import tier_folder, tier_label, with_tier_names

PREDICTION = "item_id bigint, predicted_quality int, confidence double, success boolean"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def doubles(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_softmax_is_stable_and_sums_to_one(spark):
    probs = one(spark, fn.softmax(doubles(1000, 1001, 999)))
    assert abs(sum(probs) - 1) < 1e-12
    weights = [math.exp(v) for v in (-1, 0, -2)]
    assert probs == pytest.approx([w / sum(weights) for w in weights])


def test_argmax_takes_the_first_of_equal_values(spark):
    assert one(spark, fn.argmax(doubles(0.2, 0.4, 0.4))) == 1


def test_distribution_moments(spark):
    probs = doubles(0.5, 0, 0.5)
    assert one(spark, fn.expected_score(probs)) == 2
    assert one(spark, fn.score_std(probs)) == 1


@pytest.mark.parametrize("score,word", [(6.5, "Average"), (6.51, "High"), (4.5, "Low"), (4.51, "Average")])
def test_assessment_is_strict(spark, score, word):
    assert one(spark, fn.assessment(F.lit(score))) == word


def test_zero_vector_stays_zero(spark):
    assert one(spark, fn.l2_normalise(doubles(0, 0))) == [0.0, 0.0]


def test_half_way_rounding(spark):
    assert one(spark, fn.score_category(F.lit(2.5))) == "Qualité 2"
    assert one(spark, fn.score_category(F.lit(3.5))) == "Qualité 4"
    assert one(spark, fn.clip_round_score(F.lit(7.123))) == 5.0
    assert one(spark, fn.clip_round_score(F.lit(-0.3))) == 0.0


def test_hamming_of_negative_words(spark):
    assert one(spark, fn.hamming(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


@pytest.mark.parametrize(
    "path,stem,ext", [("/a/b.c.jpg", "b.c", "jpg"), ("x", "x", ""), ("/d/.profile", ".profile", ""), ("/d/a.", "a", "")]
)
def test_path_pieces(spark, path, stem, ext):
    assert one(spark, fn.stem(F.lit(path))) == stem
    assert one(spark, fn.extension(fn.basename(F.lit(path)))) == ext


def test_extension_lists(spark):
    assert one(spark, fn.normalise_exts(F.lit(" JPG, .png"))) == [".jpg", ".png"]


@pytest.mark.parametrize("value,folder", [("3", "3_Good"), ("3.0", "3_Good"), ("3.5", "Unknown_Quality"), ("x", "Unknown_Quality"), ("9", "Unknown_Quality")])
def test_tier_lookup_follows_number_equality(spark, value, folder):
    assert one(spark, tier_folder(F.lit(value))) == folder


def test_tier_label_of_null(spark):
    assert one(spark, tier_label(F.lit(None).cast("int"))) == "Unknown_Quality"


def test_tier_join_is_broadcast(spark):
    df = spark.createDataFrame([(1, 3, 0.5, True)], PREDICTION)
    plan = with_tier_names(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("label,ok", [(" 3", True), ("x", False), ("9", False), ("-1", False), (None, False)])
def test_valid_labels(spark, label, ok):
    assert one(spark, filters.valid_label(F.lit(label).cast("string"))) is ok


def test_confidence_filter_keeps_failures(spark):
    rows = [(1, 2, 0.9, True), (2, 2, 0.5, True), (3, 2, 0.4, True), (4, None, None, False)]
    df = spark.createDataFrame(rows, PREDICTION)
    assert {r.item_id for r in filters.filter_confidence(df, 0.5).collect()} == {1, 2, 4}
    assert filters.filter_confidence(df, 0).count() == 4
    report = filters.confidence_report(df, 0.5).first()
    assert (report.n_kept, report.n_dropped) == (3, 1)


def test_summaries_of_nothing(spark):
    empty = spark.createDataFrame([], PREDICTION)
    assert aggregates.prediction_summary(empty).first().status == "nothing processed"
    dist = aggregates.tier_distribution(empty).collect()
    assert len(dist) == 6 and all(r.n == 0 and r.percent == 0 for r in dist)
    assert aggregates.label_histogram(spark.createDataFrame([], "label int")).count() == 0


def test_dashboard_without_success_column(spark):
    df = spark.createDataFrame([("3",), ("n/a",), ("5",)], "predicted_quality string")
    r = aggregates.dashboard_summary(df).first()
    assert (r.total, r.n_success, r.n_failed, r.mean_quality) == (3, 3, 0, 4.0)


def test_batches_keep_slots_of_unreadable_files(spark):
    rows = [(i, None if 100 <= i < 200 or i == 0 else float(i)) for i in range(250)]
    df = spark.createDataFrame(rows, "i int, score double")
    got = {r.batch: (r.n, r.min_score) for r in aggregates.batch_stats(df, ["i"]).collect()}
    assert got == {1: (99, 1.0), 3: (50, 200.0)}


def test_equal_scores_normalise_to_the_middle(spark):
    df = spark.createDataFrame([(1, 7.0), (2, 7.0)], "item int, raw_score double")
    assert {r.score for r in aggregates.min_max_normalise(df).collect()} == {2.5}


def test_normalise_without_key(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 10.0), (3, 3.0)], "item int, raw_score double")
    assert {r.item: r.score for r in aggregates.min_max_normalise(df).collect()} == {1: 0.0, 2: 5.0, 3: 1.5}


def test_report_of_unseen_classes_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "truth int, predicted_quality int")
    rows = {r["class"]: r for r in metrics.classification_report(df).collect()}
    assert rows["Qualité 5"].f1 == 0 and rows["Qualité 5"].support == 0
    assert rows["accuracy"].f1 == 0.5 and rows["Qualité 0"].recall == 0.5


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0)], "truth double, prediction double")
    r = metrics.regression_metrics(df).first()
    assert (r.mse, r.r2) == (0.5, -1.0)


def test_missing_columns_fail_before_any_job(spark):
    with pytest.raises(schemas.MissingColumnsError, match="quality_label"):
        schemas.require_columns(spark.range(1), ["id", "quality_label"])


@pytest.mark.parametrize("name,label", [("a1b2.jpg", 5), ("image3.jpg", 2), ("image0.jpg", 0), ("7" * 60 + ".png", 5), ("000002.png", 1)])
def test_labels_from_digits(spark, name, label):
    df = spark.createDataFrame([(f"/d/{name}",)], "path string")
    assert sources.labels_from_names(df).first().label == label


def test_names_without_digits_are_dropped(spark):
    df = spark.createDataFrame([("/d/plain.jpg",)], "path string")
    assert sources.labels_from_names(df).count() == 0


def test_unknown_output_format(spark, tmp_path):
    df = spark.createDataFrame([], schemas.PREDICTIONS)
    with pytest.raises(ValueError, match="unsupported output format"):
        sources.write_predictions(df, str(tmp_path / "x"), "xlsx")


def test_position_of_a_key_with_most_rows(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(1)).alias("k"), "id")
    placed = positions.with_position(df, [F.col("id").desc()], ["k"], start=1)
    hot = sorted((r.pos, r.id) for r in placed.filter("k = 1").collect())
    assert [p for p, _ in hot] == list(range(1, len(hot) + 1))
    assert [i for _, i in hot] == sorted((i for _, i in hot), reverse=True)


def test_position_spreads_a_hot_key_over_tasks(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), "id")
    placed = positions.with_position(df, ["id"], ["k"])
    sizes = placed.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1


def test_position_with_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, o int")
    placed = positions.with_position(df, ["o"], ["k"]).collect()
    assert {(r.k, r.o): r.pos for r in placed} == {(None, 1): 0, (None, 2): 1, ("a", 1): 0}


def test_position_of_an_exploded_table_is_spread(spark):
    """The planner's estimate of a table that grows on the way says nothing about its size."""
    grown = spark.range(10).select("id", F.explode(F.sequence(F.lit(1), F.lit(3000))).alias("n"))
    placed = positions.with_position(grown, ["id", "n"])
    assert placed.groupBy(F.spark_partition_id()).count().count() > 1
    assert placed.filter("pos != id * 3000 + n - 1").isEmpty()


def test_top_board_of_a_hot_key_beyond_any_limit(spark):
    df = spark.range(5000).select(F.lit("k").alias("key"), F.col("id").alias("item"), (F.col("id") % 100).cast("double").alias("score"))
    board = positions.top_board(df, 1500, by=["key"]).orderBy("rank").collect()
    want = sorted(range(5000), key=lambda i: (-(i % 100), i))[:1500]
    assert [r.item for r in board] == want and board[0].n_others == 3500


def test_top_board_counts_the_rest(spark):
    df = spark.range(40).select(F.col("id").alias("item"), (F.col("id") % 20).cast("double").alias("score"))
    board = positions.top_board(df, 15).orderBy("rank").collect()
    assert [r.item for r in board[:4]] == [19, 39, 18, 38] and board[0].n_others == 25
    few = positions.top_board(df.filter("item < 3"), 15).collect()
    assert len(few) == 3 and few[0].n_others == 0


def test_first_pending_without_work(spark):
    items = spark.range(3).select(F.col("id").alias("item_id"), F.col("id").alias("idx"))
    assert positions.first_pending(items, items).first().next_idx == -1
