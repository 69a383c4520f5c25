"""What the training-data operators share: word rules, stage tables, checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: The characters that separate words, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Fixed value: a word, as a pattern of Java and of RE2.
WORD = r"[^\x20\x09-\x0D]+"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dirs[app] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return _local_dirs[app]


#: Removes a query's shuffle files when the query ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch that goes to Python or back: 10,000 by default, which texts and arrays make large.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: At most so many rows go to Python at once where stage tables are made, and are worked on at once.
SLICE = 1_000
#: Folders of the stage tables that this process has written and not deleted.
_stages: list[str] = []


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    What was shuffled to make it is deleted once it is written. Void columns are
    stored as strings.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df = df.withColumns({c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"})
    before = spark.conf.get(_CLEAN, None)
    most = spark.conf.get(_BATCH)
    spark.conf.set(_CLEAN, "true")
    if not 0 < int(most) <= SLICE:
        spark.conf.set(_BATCH, str(SLICE))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, most)
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    _stages.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From now on at most SLICE rows go to Python at once in this session, where it is not less already."""
    if not 0 < int(spark.conf.get(_BATCH)) <= SLICE:
        spark.conf.set(_BATCH, str(SLICE))


def release_heap(spark: SparkSession) -> None:
    """Each executor collects its garbage and gives heap that it does not need back.

    Else a JVM keeps what its largest query took, and Python workers and native
    buffers of later queries come on top. One short task an executor; what it
    misses, if others run, only stays larger.
    """
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
    spark.range(0, n, 1, n).select(F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("done")).collect()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def slices(batches, most: int = SLICE):
    """Arrow batches in parts of at most so many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def settled(name: str):
    """Makes an operator write its result as a stage table and then delete the stage
    tables that it made on the way, so only results stay in the shared folder."""

    def wrap(operator):
        @wraps(operator)
        def run(docs: DataFrame, *args, **more) -> DataFrame:
            before = len(_stages)
            out = stage_table(operator(docs, *args, **more), name)
            for path in _stages[before:-1]:
                _delete(docs.sparkSession, path)
            del _stages[before:-1]
            return out

        return run

    return wrap


def drop_stage(df: DataFrame) -> None:
    """Deletes a stage table that nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)
        _stages[:] = [s for s in _stages if s.rsplit("/", 1)[-1] != name.rsplit("/", 1)[-1]]


def drop_stages(spark: SparkSession) -> None:
    """Deletes all stage tables of this process, results too."""
    while _stages:
        _delete(spark, _stages.pop())


#: Parts that the rows of one key are dealt over by spread_join().
PARTS = 256


def spread_join(many: DataFrame, told: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """many joined with told, which has few rows a key, on the column key.

    A key may hold any share of many: its rows are dealt over PARTS by a hash of
    the column by, each part counts once against told, and the rows then join by
    key and part. So no task gets all rows of a key.
    """
    dealt = many.withColumn("__part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    pairs = dealt.groupBy(key, "__part").agg(F.lit(1).alias("__one")).drop("__one")
    return dealt.join(pairs.join(told, key), [key, "__part"], how).drop("__part")


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str]) -> DataFrame:
    """A stage table of df with sums over all rows before, in the given order: value -> name.

    Rows are dealt by range of all order columns, so the order should tell rows
    apart; sums run within each range, and each range's total (one row a range)
    is added to those behind it.
    """
    values, names = list(totals), list(totals.values())
    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), *[StructField(n, LongType()) for n in names]])

    def run(batches):
        at = [0] * len(values)
        for batch in batches:
            made = []
            for k, value in enumerate(values):
                own = batch.column(value).to_numpy(zero_copy_only=False)
                ends = np.cumsum(own, dtype=np.int64) + at[k]
                made.append(pa.array(ends - own, pa.int64()))
                at[k] = int(ends[-1]) if len(ends) else at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [f.name for f in schema])

    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).sortWithinPartitions(*order)
    summed = stage_table(ranged.mapInArrow(run, schema), "ranges")
    each = summed.groupBy("__part").agg(*[F.max(F.col(n) + F.col(v)).alias(f"__{n}") for v, n in totals.items()])
    before = each.select("__part", *[(F.sum(f"__{n}").over(Window.orderBy("__part")) - F.col(f"__{n}")).alias(f"__{n}") for n in names])
    # One row a range: at most as many as the session's shuffle partitions.
    joined = summed.join(F.broadcast(before), "__part")
    return joined.withColumns({n: F.col(n) + F.col(f"__{n}") for n in names}).drop("__part", *[f"__{n}" for n in names])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """The number of words: non-space characters that follow a space or the start."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def need_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
