"""Exact de-duplication against a persistent digest index.

The index is a table of (digest, keep_id, n) bucketed and sorted by digest. A new
batch is reduced to one row per digest first (partial aggregation runs before the
shuffle, so a digest that a third of all rows share costs one row a task), then
sort-merge anti-joined with the index on its buckets, and appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, remove, scratch_path, shared_dir, table, written


def text_digest(text: Column) -> Column:
    """SHA-256, lower-case hex, of the UTF-8 of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256)


class DigestIndex:
    """Digests seen so far, as a table bucketed and sorted by digest.

    ``location`` is a folder in a store that all executors share; an index that
    exists there is taken up again by any later session. ``buckets`` is a property
    of the stored table: choose it so that a bucket holds up to a few hundred MB.
    Each append adds one sorted file a bucket and writing task; ``compact`` merges them.

    A digest has one row with its keep_id, from the batch that brought it, and a row without one from
    each later batch that holds it again; its documents are the sum of their n.
    """

    SCHEMA = "digest string, keep_id bigint, n bigint"

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.spark, self.buckets = spark, buckets
        self.location = location or scratch_path(spark, "digest-index")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_groups(self, groups: DataFrame) -> DataFrame:
        """The digests of a batch that the index lacks: a sort-merge anti-join on the buckets."""
        return groups.hint("merge").join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def grow(self, docs: DataFrame) -> DataFrame:
        """Take up a batch (digest, doc_id); its groups that the index lacked (digest, keep_id, n)."""
        spark, groups = self.spark, written(digest_groups(docs), "digest-groups")
        # The groups are written first: else the optimiser takes the join below the aggregate, and all copies of a text to one task.
        empty = self.rows().isEmpty()
        fresh = written(self.new_groups(groups), "new-digests")
        if empty:
            self.append(fresh)
        else:
            again = groups.hint("merge").join(fresh.select("digest").hint("merge"), "digest", "left_anti")
            self.append(fresh.unionByName(again.withColumn("keep_id", F.lit(None).cast("long"))))
        remove(spark, groups._scratch)
        return fresh

    def groups(self) -> DataFrame:
        """digest, keep_id, n of all batches so far, each digest once. The files are read without their buckets, so what joins them is free to split a hot digest."""
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.location)
        return rows.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    def append(self, groups: DataFrame) -> None:
        (
            groups.select("digest", "keep_id", "n")
            .repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .saveAsTable(self.name, path=self.location)
        )

    def compact(self) -> None:
        """Rewrite the index with one row a digest and one file a bucket (after many small appends). Until it ends, a copy stands in the shared folder."""
        kept = written(self.groups(), "compact")
        remove(self.spark, self.location)
        self.spark.catalog.refreshTable(self.name)
        self.append(kept)
        remove(self.spark, kept._scratch)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digest_groups(docs: DataFrame) -> DataFrame:
    """One row per digest: the largest doc_id stays, n counts the group. Repeated doc_ids count once per row."""
    return docs.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def dedup_batch(index: DigestIndex, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` (doc_id, text, ...) whose text is new, one for each text, and the index grown by them.

    The row with the largest doc_id of each group stays; of rows equal in text and
    doc_id one stays for each distinct row. Null text counts as empty. An empty batch gives no rows.
    Extra columns are kept as they are.
    """
    work = batch.select(F.struct(*[batch[c] for c in batch.columns]).alias("r"), text_digest(batch["text"]).alias("digest"), batch["doc_id"].alias("doc_id"))
    digests = written(work.select("digest", "doc_id"), "digests")
    groups = index.grow(digests)
    keep = groups.select("digest", F.col("keep_id").alias("doc_id"))
    out = _semi(work, keep)
    twice = digests.groupBy("digest", "doc_id").count().where("count > 1").select("digest", "doc_id")
    if not twice.isEmpty():
        again = _semi(work, twice)
        again = _semi(again, keep).groupBy("digest", "doc_id").agg(F.min("r").alias("r"))
        out = _semi(out, twice, "left_anti").unionByName(again.select("r", "digest", "doc_id"))
    return out.select("r.*")


def _semi(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.join(keys, rows["doc_id"].eqNullSafe(keys["doc_id"]) & (rows["digest"] == keys["digest"]), how)


def report(spark: SparkSession, documents: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The documents are the batch; the groups they form are anti-joined with the index
    and appended to it, and the report joins each document with its group as the
    index now holds it. With a filled index given, a text that it already holds keeps the
    index's keep_id, and group_size counts the documents of all batches. Null text counts as empty, null doc_ids stay in the report with
    kept = false unless the group has no other; repeated rows each get a row.
    """
    own = index is None
    index = index or DigestIndex(spark)
    docs = written(documents.select("doc_id", text_digest(documents["text"]).alias("digest")), "digests")
    index.grow(docs)
    # An index of this batch alone has one row a digest as it is.
    groups = spark.read.schema(DigestIndex.SCHEMA).parquet(index.location) if own else index.groups()
    if own:
        index.close()
    out = docs.hint("merge").join(groups.hint("merge"), "digest")
    return out.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all ``documents`` from an empty index. Null and empty texts are one group, repeated rows each have a row, an empty table gives none."""
    return report(spark, table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, that of the largest doc_id (of rows without an id, one); null and empty texts are one text, an empty table stays empty."""
    index = DigestIndex(spark)
    out = dedup_batch(index, docs)
    index.close()
    return out


__all__ = ["DigestIndex", "dedup_batch", "digest_groups", "op10_exact_dedup", "report", "text_digest", "shared_dir"]
