"""Splits and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import derived, query
from lumenrank import sources
from lumenrank.operators import fingerprints, learning
from lumenrank.session import scratch_root


@query(
    """select l_orderkey || '/' || l_linenumber || '/' || l_partkey item_id,
 case when ('0x' || substr(md5(l_orderkey || '/' || l_linenumber || '/' || l_partkey || '|42'), 1, 8))::bigint / 4294967296.0::double < 0.2 then 'test' else 'train' end split from lineitem"""
)
def train_test_split(spark, sf):
    rows = derived.table(spark, sf, "lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey").alias("item_id")
    )
    return learning.split_train_test(rows, 0.2, 42)


def _described(spark, sf):
    labels = derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), (F.col("label") % 6).cast("int").alias("label")
    )
    return fingerprints.grid_descriptors(derived.grid(spark, sf)).join(labels, "item_id")


@query()
def quality_forest_metrics(spark, sf):
    """Forest of 100 trees on descriptors: error and R2 on the held-out rows."""
    return learning.train_quality_forest(_described(spark, sf))[1]


@query()
def quality_forest_predictions(spark, sf):
    """Forest saved, reloaded and applied to all rows."""
    rows = _described(spark, sf)
    model, _ = learning.train_quality_forest(rows, numTrees=20)
    path = f"{scratch_root(spark)}/forest-{sf.strip('/').replace('/', '_')}"
    sources.write_ml_model(model, path)
    return learning.predict_quality_forest(sources.load_ml_model(path), rows)


@query()
def quality_head_predictions(spark, sf):
    """Six-class linear head trained on the training side, applied to all rows."""
    rows = derived.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("features"), (F.col("label") % 6).cast("int").alias("label")
    )
    parts = learning.split_train_test(rows, 0.3)
    model = learning.train_quality_head(parts.filter("split = 'train'"))
    return learning.predict_quality_head(model, parts).select("item_id", "split", "label", "predicted_quality", "confidence")
