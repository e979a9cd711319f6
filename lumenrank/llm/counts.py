"""Operator 4, token counts as delta-maintained rollups.

A ledger in shared storage keeps signed entries. A batch of inserts, deletes
and revised counts is turned into entries against what the ledger holds of the
same documents: an insert adds, a delete takes back what was counted, a
revision does both. Each batch also keeps its sums by source, language and
tokenizer version, so the totals are an addition over small tables and never
a new count.

A batch is committed by one marker, written after its entries and sums.
Committing a batch again changes nothing; what an interrupted commit has left
is written over by the next attempt. One writer at a time.

Defined results: a null text has no tokens; null source, language or id are
values of their own. An insert of a known document is a revision, a delete of
an unknown one has no effect. A batch holds one change per document and
version; of several, the greatest by (op, tokens, source, lang) counts, so
repeated rows count once. An empty batch is committed and adds nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.registry import documents, query
from lumenrank.llm.text import words
from lumenrank.llm.tokens import batches, default_vocabulary, piece_ids
from lumenrank.session import materialise, scratch_root

GROUP = ("source", "lang", "version")
INSERT, DELETE, REVISE = "insert", "delete", "revise"
_ENTRY = "doc_id {id}, source string, lang string, version string, docs long, tokens long"


class TokenLedger:
    """Totals of documents and tokens below the folder ``root``, which all executors share."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "bigint"):
        self.spark, self.root = spark, root.rstrip("/")
        self.entry_schema = _ENTRY.format(id=id_type)

    def _path(self, kind: str, batch: str) -> str:
        return f"{self.root}/{kind}/{batch}"

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        sc = self.spark.sparkContext
        folder = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits")
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._path(kind, b) for b in done])

    def entries(self) -> DataFrame:
        return self._read("entries", self.entry_schema)

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens`` over all committed batches; groups that hold a document."""
        sums = self._read("sums", "source string, lang string, version string, docs long, tokens long")
        total = sums.groupBy(*GROUP).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return total.filter("n_docs > 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``doc_id, op, source, lang, version, tokens``; False if the batch was committed before."""
        if batch in self.batches():
            return False
        named = changes.select(
            "doc_id", "version", F.struct("op", F.col("tokens").cast("long").alias("tokens"), "source", "lang").alias("c")
        )
        wanted = materialise(named.groupBy("doc_id", "version").agg(F.max("c").alias("c")), "changes")
        ids = wanted.select(F.col("doc_id").alias("_d"), F.col("version").alias("_v"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("version").eqNullSafe(F.col("_v"))
        held = (
            self.entries().join(ids, same, "left_semi").groupBy("doc_id", *GROUP)
            .agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs != 0 OR tokens != 0")
        )
        taken = held.select("doc_id", *GROUP, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
        added = wanted.filter(F.col("c.op") != DELETE).select(
            "doc_id", "c.source", "c.lang", "version", F.lit(1).cast("long").alias("docs"),
            F.coalesce("c.tokens", F.lit(0)).cast("long").alias("tokens"),
        )
        taken.unionByName(added).write.mode("overwrite").parquet(self._path("entries", batch))
        written = self.spark.read.schema(self.entry_schema).parquet(self._path("entries", batch))
        sums = written.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(self._path("sums", batch))
        self.spark.range(1, numPartitions=1).write.mode("overwrite").parquet(self._path("commits", batch))
        return True


def token_counts(docs: DataFrame, vocabulary: str | None = None, version: str = "word_bpe_49k") -> DataFrame:
    """``doc_id, source, lang, version, tokens``: whole texts counted by the vocabulary, and their plain words."""
    import pyarrow as pa

    path = vocabulary or default_vocabulary()

    def count(table):
        for batch in table:
            texts, sizes = batch.column(3), []
            for lo, hi in batches(texts):
                borders = piece_ids(path).encode(texts.slice(lo, hi - lo))[1]
                sizes += (borders[1:] - borders[:-1]).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64())], names=["doc_id", "source", "lang", "tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    pieces = rows.mapInArrow(count, f"doc_id {kind}, source string, lang string, tokens long")
    plain = rows.select("doc_id", "source", "lang", F.size(words(F.col("text"))).cast("long").alias("tokens"))
    return pieces.withColumn("version", F.lit(version)).unionByName(plain.withColumn("version", F.lit("words-1")))


def document_key() -> Column:
    """Names a document by its id and text, so rows without an id, and rows of one id with unlike texts, count each."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("null "))))


def maintain(docs: DataFrame, root: str, vocabulary: str | None = None) -> DataFrame:
    """Totals after three batches: all documents, revised counts without repeated lines, exact copies deleted."""
    spark = docs.sparkSession
    ledger = TokenLedger(spark, root, "string")
    named = docs.select(document_key().alias("doc_id"), "source", "lang", "text", F.col("doc_id").alias("_id"))
    ledger.commit("load", token_counts(named, vocabulary).withColumn("op", F.lit(INSERT)))

    once = F.array_join(F.array_distinct(F.split("text", "\n", -1)), "\n")
    changed = named.select("doc_id", "source", "lang", "text", once.alias("_once")).filter(F.length("_once") < F.length("text"))
    revised = token_counts(changed.select("doc_id", "source", "lang", F.col("_once").alias("text")), vocabulary)
    revision = materialise(revised.withColumn("op", F.lit(REVISE)), "revised")
    ledger.commit("revise", revision)

    earliest = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("doc_id").alias("key"))
    firsts = named.groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("_m")).agg(F.min(earliest).alias("_keep"))
    copies = named.select("doc_id").distinct().join(firsts.select(F.col("_keep.key").alias("doc_id")), "doc_id", "left_anti")
    versions = F.explode(F.array(F.lit("word_bpe_49k"), F.lit("words-1"))).alias("version")
    nothing = F.lit(None).cast("string")
    gone = copies.select("doc_id", F.lit(DELETE).alias("op"), nothing.alias("source"), nothing.alias("lang"), F.lit(0).alias("tokens"), versions)
    ledger.commit("copies", gone)
    ledger.commit("revise", revision)  # a repeated commit, which has no effect
    return ledger.totals()


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain(documents(spark, sf_dir), f"{scratch_root(spark)}/ledger-{uuid.uuid4().hex}")
