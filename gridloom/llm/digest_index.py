"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is first
reduced to one winner a digest (partial aggregation, so a hot digest shrinks to
one row a task), then anti-joined with the index on the digest, and appended.
The index side of that join is read in its buckets and not shuffled. The layout
is kept beside the table; one that is opened with another layout is refused.

Defined results: null text counts as empty; texts are equal when identical
without the characters [\\x20\\x09-\\x0D]; of equal texts in a batch the one with
the most code points stays, then the smallest doc_id (a null doc_id last). Rows
that repeat a doc_id and a text length share their fate in deduplicate();
keep_first_copies() keeps one of them. What an earlier batch indexed stays the
keeper, and group_size counts the rows of the batch that brought a digest in.
An empty batch gives no rows. Other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, need_columns, settled, stage_table, text_or_empty

#: At most so many digests count as hot, so the table of them can be broadcast.
HOT_DIGESTS = 1000
#: The index's columns.
SCHEMA = "text_sha256 STRING, keep_id BIGINT, n_points BIGINT, group_size BIGINT, n_keepers BIGINT"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_sha256 (lowercase hex of the text without spaces), n_points."""
    need_columns(docs, "doc_id", "text")
    bare = F.translate(text_or_empty(), SPACES, "")
    return docs.select("doc_id", F.sha2(bare.cast("binary"), 256).alias("text_sha256"), F.length(text_or_empty()).cast("long").alias("n_points"))


def winners(rows: DataFrame) -> DataFrame:
    """One row a digest: text_sha256, keep_id, n_points, group_size, n_keepers (rows like the keeper).

    Equal rows are counted first, so that both steps are sums and minima over partial results.
    """
    alike = rows.groupBy("text_sha256", "doc_id", "n_points").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n_points")).alias("neg"), F.col("doc_id").isNull().alias("nil"), "doc_id", "n"))
    found = alike.groupBy("text_sha256").agg(best.alias("best"), F.sum("n").alias("group_size"))
    return found.select("text_sha256", F.col("best.doc_id").alias("keep_id"), (-F.col("best.neg")).alias("n_points"), "group_size", F.col("best.n").alias("n_keepers"))


class DigestIndex:
    """A digest table; with a path it lives on there and can be opened again."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        stored = self._stored(path)
        if stored and buckets and buckets != stored:
            raise ValueError(f"the index has {stored} buckets, not {buckets}")
        self.buckets = stored or buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not spark.catalog.tableExists(self.name):
            if path and not stored:
                spark.createDataFrame([(self.buckets, SCHEMA)], "buckets int, columns string").coalesce(1).write.json(f"{path}/_layout")
            where = f" LOCATION '{path}'" if path else ""
            spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet CLUSTERED BY (text_sha256) SORTED BY (text_sha256) INTO {self.buckets} BUCKETS{where}")

    def _stored(self, path: str | None) -> int | None:
        """The number of buckets of the table of this name or, new to the catalogue, at this path."""
        if self.spark.catalog.tableExists(self.name):
            told = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            return int(told["Num Buckets"])
        at = path and self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_layout")
        if not at or not at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            return None
        layout = self.spark.read.schema("buckets int, columns string").json(f"{path}/_layout").first()
        if layout["columns"] != SCHEMA:
            raise ValueError(f"the index at {path} has other columns: {layout['columns']}")
        return layout["buckets"]

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table out of the catalogue; without a path its data goes too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, batch: DataFrame) -> None:
        """Appends the winners of a batch's digests() that the index lacks.

        The winners are a stage table: else the anti-join would be pushed below
        their aggregation, and all rows of a hot digest would meet in one task.
        """
        found = stage_table(winners(batch), "winners")
        new = found.join(self.table().select("text_sha256").hint("merge"), "text_sha256", "left_anti")
        # One file a bucket: the writer sorts each by the digest.
        new.repartition(self.buckets, "text_sha256").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def resolve(self, rows: DataFrame) -> DataFrame:
        """Adds keep_id, group_size and kept to digests() rows that were ingested.

        A digest is hot if it has over a HOT_DIGESTS-th of these rows, so fewer
        than HOT_DIGESTS are, and only those are broadcast; no group larger than
        that reaches one task of the merge join.
        """
        counts = stage_table(rows.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")), "counts")
        floor = max(64, (counts.agg(F.sum("n")).first()[0] or 0) // HOT_DIGESTS)
        index = self.table().select("text_sha256", "keep_id", F.col("n_points").alias("keep_points"), "group_size")
        hot = stage_table(index.join(F.broadcast(counts.where(F.col("n") > floor).select("text_sha256")), "text_sha256", "left_semi"), "hot")
        large = rows.join(F.broadcast(hot), "text_sha256")
        rest = rows.join(F.broadcast(hot.select("text_sha256")), "text_sha256", "left_anti")
        rest = rest.join(index.hint("merge"), "text_sha256")
        kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_points") == F.col("keep_points"))
        return large.unionByName(rest).withColumn("kept", kept)


@settled("exact")
def deduplicate(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage_table(digests(docs), "digests")
    index = DigestIndex(docs.sparkSession)
    try:
        index.ingest(rows)
        out = stage_table(index.resolve(rows), "resolved")
    finally:
        index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """One row of docs for each text that deduplicate() keeps, with all its columns."""
    index = DigestIndex(docs.sparkSession)
    try:
        index.ingest(digests(docs))
        keepers = stage_table(index.table().select("text_sha256", "keep_id", "n_points", "n_keepers"), "keepers")
    finally:
        index.drop()
    named = keepers.toDF("__sha", "__id", "__points", "__alike")
    bare = F.sha2(F.translate(text_or_empty(), SPACES, "").cast("binary"), 256)
    rows = docs.withColumns({"__own_sha": bare, "__own_points": F.length(text_or_empty())})
    # The id comes first: of the few rows that share a keeper's id, digest and length tell which is it.
    same = rows["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own_sha") == F.col("__sha")) & (F.col("__own_points") == F.col("__points"))
    kept = rows.join(named, same)
    single = kept.where("__alike = 1").select(*docs.columns)
    if keepers.where("n_keepers > 1").isEmpty():
        return single
    # Equal rows of one id: any of them.
    return single.unionByName(kept.where("__alike > 1").dropDuplicates(["__sha"]).select(*docs.columns))
