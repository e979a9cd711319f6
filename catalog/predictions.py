"""Predictions: functions, filters, summaries, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived, query
from catalog.derived import OUT_OF_RANGE
from lumenrank import functions as fn
from lumenrank.operators import aggregates, filters, metrics, positions, scoring
from lumenrank.plans import evaluate_predictions, score_library
from lumenrank.tiers import tier_folder, with_tier_names


@query(
    """select item_id, list_transform(all_probabilities, lambda x: round(x, 6)) probs, predicted_quality,
 round(confidence, 6) confidence from predictions where success""",
    uses="predictions",
)
def class_probabilities(spark, sf):
    """softmax, argmax and confidence of model outputs."""
    return derived.predictions(spark, sf).filter("success").select(
        "item_id",
        F.transform("all_probabilities", lambda x: F.round(x, 6)).alias("probs"),
        "predicted_quality",
        F.round("confidence", 6).alias("confidence"),
    )


def make_scorer():
    """Caller's model: the vector folded into six logits; refuses vectors out of range."""

    def predict(batch):
        if any(max(v) > OUT_OF_RANGE for v in batch):
            raise ValueError("value out of range")
        return [[sum(float(x) * 10 for x in v[i::6]) for i in range(6)] for v in batch]

    return predict


@query(
    """select item_id, success, error, predicted_quality, quality_label, round(confidence, 6) confidence from predictions""",
    uses="predictions",
)
def batch_scoring(spark, sf):
    """Scoring hook in batches; a failing batch is retried row by row."""
    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    scored = scoring.class_predictions(scoring.score_batches(vectors, make_scorer, "embedding"))
    return scored.select(
        "item_id", "success", "error", "predicted_quality", "quality_label", F.round("confidence", 6).alias("confidence")
    )


@query(
    """select item_id, len(probs) n_grades, round(list_sum(list_transform(probs, lambda p, i: p*i)), 6) mean_score from ratings10""",
    uses="ratings10",
)
def distribution_scoring(spark, sf):
    """Scoring hook that returns a rating distribution."""

    def make_predict():
        import numpy as np

        def predict(batch):
            e = np.exp(np.array([[sum(float(x) * 10 for x in v[i::10]) for i in range(10)] for v in batch]))
            return e / e.sum(axis=1, keepdims=True)

        return predict

    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    scored = scoring.distribution_scores(scoring.score_batches(vectors, make_predict, "embedding"))
    return scored.select("item_id", F.size("output").cast("bigint").alias("n_grades"), F.round("mean_score", 6).alias("mean_score"))


@query("select vec_id item_id, true success, round(list_sum(list_transform(embedding, lambda x: x::double)) / len(embedding), 6) score from embeddings")
def scalar_scoring(spark, sf):
    """Scoring hook that returns one number."""
    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    scored = scoring.score_batches(vectors, lambda: (lambda batch: [[sum(map(float, v)) / len(v)] for v in batch]), "embedding")
    return scoring.scalar_scores(scored).select("item_id", "success", F.round("score", 6).alias("score"))


@query(
    """with k as (select * from predictions where not success or confidence >= 0.4)
 select count(*) filter (where success) n_success, count(*) filter (where not success) n_failed,
 round(avg(predicted_quality), 6) mean_quality, round(avg(confidence), 6) mean_confidence from k""",
    uses="predictions",
)
def library_scoring_report(spark, sf):
    """Scoring, threshold and summary as one workflow."""
    vectors = derived.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    s = score_library(vectors, make_scorer, "embedding", threshold=0.4).summary
    return s.select(
        "n_success", "n_failed", F.round("mean_quality", 6).alias("mean_quality"),
        F.round("mean_confidence", 6).alias("mean_confidence"),
    )


@query(
    """with m as (select item_id, list_sum(list_transform(probs, lambda p, i: p*i)) mu, probs from ratings10)
 select item_id, round(mu, 6) mean_score, round(sqrt(list_sum(list_transform(probs, lambda p, i: (i-mu)*(i-mu)*p))), 6) std_dev,
 case when mu > 6.5 then 'High' when mu > 4.5 then 'Average' else 'Low' end assessment from m""",
    uses="ratings10",
)
def rating_distribution_scores(spark, sf):
    """Mean grade, deviation and assessment of rating distributions."""
    mean = fn.expected_score(F.col("probs"))
    return derived.ratings10(spark, sf).select(
        "item_id",
        F.round(mean, 6).alias("mean_score"),
        F.round(fn.score_std(F.col("probs")), 6).alias("std_dev"),
        fn.assessment(mean).alias("assessment"),
    )


@query(
    """select item_id, success, round(confidence, 6) confidence from predictions where not success or confidence >= 0.5""",
    uses="predictions",
)
def confidence_filter(spark, sf):
    kept = filters.filter_confidence(derived.predictions(spark, sf), 0.5)
    return kept.select("item_id", "success", F.round("confidence", 6).alias("confidence"))


@query(
    """select count(*) filter (where not success or confidence >= 0.5) n_kept,
 count(*) filter (where success and confidence < 0.5) n_dropped from predictions""",
    uses="predictions",
)
def confidence_filter_report(spark, sf):
    return filters.confidence_report(derived.predictions(spark, sf), 0.5)


@query(
    """select item_id, predicted_quality, case when predicted_quality is null then 'Unknown_Quality' else
  ['0_VeryPoor','1_Poor','2_Medium','3_Good','4_VeryGood','5_Excellent'][predicted_quality+1] end folder,
 coalesce(quality_label, 'Unknown_Quality') as label,
 coalesce('Qualité ' || predicted_quality, 'Unknown_Quality') report_name from predictions""",
    uses="predictions",
)
def tier_names(spark, sf):
    """Broadcast join with the tier table."""
    named = with_tier_names(derived.predictions(spark, sf))
    return named.select("item_id", "predicted_quality", "folder", "label", "report_name")


@query(
    """select l_orderkey, l_linenumber, case when l_quantity - 1 between 0 and 5 and l_quantity = floor(l_quantity)
 then ['0_VeryPoor','1_Poor','2_Medium','3_Good','4_VeryGood','5_Excellent'][l_quantity::int] else 'Unknown_Quality' end folder from lineitem"""
)
def tier_folder_lookup(spark, sf):
    """Tier lookup on floating codes, unknown for everything off the scale."""
    return derived.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", tier_folder(F.col("l_quantity") - 1).alias("folder")
    )


@query(
    """select item_id, predicted_quality, round(all_probabilities[1],6) prob_quality_0, round(all_probabilities[2],6) prob_quality_1,
 round(all_probabilities[3],6) prob_quality_2, round(all_probabilities[4],6) prob_quality_3,
 round(all_probabilities[5],6) prob_quality_4, round(all_probabilities[6],6) prob_quality_5 from predictions""",
    uses="predictions",
)
def probability_columns(spark, sf):
    """Probability array as columns and back."""
    preds = derived.predictions(spark, sf).select("item_id", "predicted_quality", "all_probabilities")
    there_and_back = filters.pack_probs(filters.spread_probs(preds))
    wide = filters.spread_probs(there_and_back)
    return wide.select(
        "item_id", "predicted_quality", *[F.round(f"prob_quality_{i}", 6).alias(f"prob_quality_{i}") for i in range(6)]
    )


@query(
    """select doc_id, text_label, coalesce(try_cast(trim(text_label) as int) between 0 and 5, false) valid from
 (select doc_id, case n_chars % 5 when 0 then ' 3' when 1 then 'x' when 2 then '9' when 3 then n_chars::varchar else (n_chars % 6)::varchar end text_label from documents)"""
)
def label_validation(spark, sf):
    n = F.col("n_chars")
    text = (
        F.when(n % 5 == 0, F.lit(" 3")).when(n % 5 == 1, F.lit("x")).when(n % 5 == 2, F.lit("9"))
        .when(n % 5 == 3, n.cast("string")).otherwise((n % 6).cast("string"))
    )
    rows = derived.table(spark, sf, "documents").select("doc_id", text.alias("text_label"))
    return rows.withColumn("valid", filters.valid_label(F.col("text_label")))


@query(
    """with p as (select l_orderkey, l_linenumber, greatest(0.0, least(5.0, round_even(l_extendedprice / 17000.0, 2))) predicted_quality from lineitem)
 select l_orderkey, l_linenumber, predicted_quality, 'Qualité ' || round_even(predicted_quality, 0)::int quality_category from p"""
)
def score_clipping(spark, sf):
    """Continuous scores rounded half-even, limited to the scale, and named."""
    score = fn.clip_round_score(F.col("l_extendedprice") / 17000.0)
    return derived.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", score.alias("predicted_quality"), fn.score_category(score).alias("quality_category")
    )


@query(
    """select count(*) filter (where success) n_success, count(*) filter (where not success) n_failed,
 round(avg(predicted_quality), 6) mean_quality, round(avg(confidence), 6) mean_confidence,
 case when count(*) filter (where success) = 0 then 'nothing processed' else 'ok' end status from predictions""",
    uses="predictions",
)
def prediction_summary(spark, sf):
    s = aggregates.prediction_summary(derived.predictions(spark, sf))
    return s.select(
        "n_success", "n_failed", F.round("mean_quality", 6).alias("mean_quality"),
        F.round("mean_confidence", 6).alias("mean_confidence"), "status",
    )


@query(
    """with c as (select predicted_quality tier, count(*) n from predictions where success group by 1)
 select cast(t.tier as int) tier, ['Tres mauvaise','Mauvaise','Mediocre','Correcte','Bonne','Excellente'][t.tier+1] as label,
 coalesce(n, 0) n, coalesce(round(100.0 * n / (select sum(n) from c), 6), 0) percent
 from range(0,6) t(tier) left join c on c.tier = t.tier""",
    uses="predictions",
)
def tier_distribution(spark, sf):
    return aggregates.tier_distribution(derived.predictions(spark, sf))


@query(
    """select l_returnflag, count(*) n, min(l_extendedprice) min_score, max(l_extendedprice) max_score,
 round(avg(l_extendedprice), 4) mean_score, round(stddev_pop(l_extendedprice), 4) std_score from lineitem group by 1"""
)
def score_statistics(spark, sf):
    s = aggregates.score_stats(derived.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.withColumns({"mean_score": F.round("mean_score", 4), "std_score": F.round("std_score", 4)})


@query(
    """with o as (select *, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) // 100 + 1 batch from lineitem)
 select batch, count(case when l_quantity > 2 then 1 end) n, min(case when l_quantity > 2 then l_extendedprice end) min_score,
 round(avg(case when l_quantity > 2 then l_extendedprice end), 4) mean_score from o group by 1
 having count(case when l_quantity > 2 then 1 end) > 0"""
)
def batch_statistics(spark, sf):
    """Statistics per batch of 100 in listing order; null scores keep their slot."""
    rows = derived.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_quantity") > 2, F.col("l_extendedprice")).alias("score"),
    )
    s = aggregates.batch_stats(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return s.withColumn("mean_score", F.round("mean_score", 4))


@query(
    """select count(*) total, count(*) filter (where success) n_success, count(*) filter (where not success) n_failed,
 round(avg(predicted_quality), 6) mean_quality from predictions""",
    uses="predictions",
)
def dashboard_summary(spark, sf):
    textual = derived.predictions(spark, sf).select(
        "success", F.coalesce(F.col("predicted_quality").cast("string"), F.lit("n/a")).alias("predicted_quality")
    )
    return aggregates.dashboard_summary(textual).withColumn("mean_quality", F.round("mean_quality", 6))


@query(
    """with c as (select l_linenumber::int as label, count(*) n from lineitem group by 1)
 select r.i::int as label, coalesce(n, 0) n from range(0, (select max(label) + 1 from c)) r(i) left join c on c.label = r.i"""
)
def label_histogram(spark, sf):
    return aggregates.label_histogram(derived.table(spark, sf, "lineitem"), "l_linenumber")


@query(
    """with l as (select item_id, arg_max(label, row_num) as label from annotation_log group by 1) select item_id, label from l""",
    uses="annotation_log",
)
def latest_labels(spark, sf):
    return aggregates.latest_label(derived.annotation_log(spark, sf))


@query(
    """select count(l.doc_id) done, count(*) total, count(*) - count(l.doc_id) remaining
 from documents d left join (select distinct doc_id from labels) l on l.doc_id = d.doc_id"""
)
def annotation_progress(spark, sf):
    items = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return aggregates.annotation_progress(items, derived.annotation_log(spark, sf))


@query("select doc_id item_id, lang from documents where doc_id not in (select doc_id from labels)")
def pending_items(spark, sf):
    """Items without an annotation."""
    items = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    return filters.pending_items(items, derived.annotation_log(spark, sf))


@query(
    """select coalesce(min(doc_id), -1) next_idx from documents where doc_id >= 10 and doc_id not in (select doc_id from labels)"""
)
def first_pending_item(spark, sf):
    items = derived.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("idx"))
    return positions.first_pending(items, derived.annotation_log(spark, sf), start=10)


_CELLS = """with c as (select truth, predicted_quality p, count(*) n from predictions where success group by 1, 2),
 g as (select cast(t.i as int) truth, cast(p.i as int) predicted, coalesce(n, 0)::bigint n from range(0,6) t(i)
  cross join range(0,6) p(i) left join c on c.truth = t.i and c.p = p.i)"""


@query(
    _CELLS + """ select truth, sum(case when predicted=0 then n else 0 end)::bigint predicted_0, sum(case when predicted=1 then n else 0 end)::bigint predicted_1,
 sum(case when predicted=2 then n else 0 end)::bigint predicted_2, sum(case when predicted=3 then n else 0 end)::bigint predicted_3,
 sum(case when predicted=4 then n else 0 end)::bigint predicted_4, sum(case when predicted=5 then n else 0 end)::bigint predicted_5 from g group by 1""",
    uses="predictions",
)
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(derived.predictions(spark, sf).filter("success"))


@query(
    _CELLS + """, k as (select t.i c, sum(case when truth=t.i and predicted=t.i then n else 0 end)::double tp,
  sum(case when truth=t.i then n else 0 end)::double s, sum(case when predicted=t.i then n else 0 end)::double q from g, range(0,6) t(i) group by 1),
 m as (select c, s, coalesce(tp / nullif(q,0), 0) p, coalesce(tp / nullif(s,0), 0) r, coalesce(2*tp / nullif(q+s,0), 0) f, tp from k),
 a as (select sum(tp)/sum(s) acc, sum(s)::bigint total from m)
 select 'Qualité ' || c as class, round(p,6) as precision, round(r,6) recall, round(f,6) f1, s::bigint support from m
 union all select 'accuracy', round(acc,6), round(acc,6), round(acc,6), total from a
 union all select 'macro avg', round(avg(p),6), round(avg(r),6), round(avg(f),6), sum(s)::bigint from m
 union all select 'weighted avg', round(sum(p*s)/sum(s),6), round(sum(r*s)/sum(s),6), round(sum(f*s)/sum(s),6), sum(s)::bigint from m""",
    uses="predictions",
)
def classification_report(spark, sf):
    r = metrics.classification_report(derived.predictions(spark, sf).filter("success"))
    return r.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


_ERRORS = """select round(avg((predicted_quality = truth)::int::double), 6) accuracy, round(avg(pow(predicted_quality - truth, 2)), 6) mse,
 round(sqrt(avg(pow(predicted_quality - truth, 2))), 6) rmse from predictions where success"""


@query(_ERRORS, uses="predictions")
def accuracy_and_errors(spark, sf):
    m = metrics.accuracy_mse_rmse(derived.predictions(spark, sf).filter("success"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(_ERRORS, uses="predictions")
def evaluation_workflow(spark, sf):
    """Predictions joined with the truth by item, then scored."""
    preds = derived.predictions(spark, sf).select("item_id", "success", "predicted_quality")
    truth = derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), (F.col("label") % 6).cast("int").alias("truth")
    )
    m = evaluate_predictions(preds, truth).errors
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(
    """select round(avg(pow(l_extendedprice - 1500 * l_quantity, 2)), 2) mse,
 round(1 - sum(pow(l_extendedprice - 1500 * l_quantity, 2)) / (var_pop(l_extendedprice) * count(*)), 6) r2 from lineitem"""
)
def regression_metrics(spark, sf):
    rows = derived.table(spark, sf, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("prediction"))
    m = metrics.regression_metrics(rows, "l_extendedprice", "prediction")
    return m.select(F.round("mse", 2).alias("mse"), F.round("r2", 6).alias("r2"))


@query(
    """select item_id, round(confidence, 6) confidence, predicted_quality from predictions""", uses="predictions"
)
def items_by_score(spark, sf):
    """Scored table, best first."""
    ranked = positions.order_by_score(derived.predictions(spark, sf), "confidence")
    return ranked.select("item_id", F.round("confidence", 6).alias("confidence"), "predicted_quality")


@query(
    """with u as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::double*x::double))) n from embeddings)
 select vec_id item_id, list_transform(embedding, lambda x: round(x::double / greatest(n, 1e-12), 6)) features,
 round(list_cosine_distance(embedding::double[], list_reverse(embedding)::double[]), 6) mirror_distance from u"""
)
def vector_functions(spark, sf):
    """Unit vectors and cosine distance."""
    v = F.col("embedding")
    return derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.transform(fn.l2_normalise(v), lambda x: F.round(x, 6)).alias("features"),
        F.round(fn.cosine_distance(v, F.reverse(v)), 6).alias("mirror_distance"),
    )


@query(
    """with m as (select vec_id, embedding, list_aggregate(embedding::double[], 'median') md from embeddings)
 select vec_id item_id, list_sum(list_transform(embedding, lambda x, i: case when x::double > md and i < 64 then (1::bigint << (i-1)::int)::hugeint
  when x::double > md then -9223372036854775808::hugeint else 0::hugeint end))::bigint h from m"""
)
def median_bit_hash(spark, sf):
    return derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), fn.median_bits(F.col("embedding")).alias("h")
    )


@query(
    """select l_orderkey, l_linenumber, round(1/(1+pow(10.0, (l_quantity*10 - l_extendedprice/100)/400.0)), 6) expected from lineitem"""
)
def elo_expectation(spark, sf):
    return derived.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.round(fn.elo_expected(F.col("l_extendedprice") / 100, F.col("l_quantity") * 10), 6).alias("expected"),
    )
