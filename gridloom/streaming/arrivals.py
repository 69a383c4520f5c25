"""Workbooks as they arrive in a folder: an addition of this engine.

A file counts once, by its content, within the watermark; what is read from it
are the same tables as in batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.workbook import TABLES, rows


def arrivals(spark: SparkSession, path: str, keep: str = "1 day") -> DataFrame:
    """path, content, arrived and sha256 of each new file; a copy within keep is dropped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    marked = files.select("path", "content", F.col("modificationTime").alias("arrived"), F.sha2("content", 256).alias("sha256"))
    return marked.withWatermark("arrived", keep).dropDuplicatesWithinWatermark(["sha256"])


def tables(files: DataFrame, table: str = "cells") -> DataFrame:
    """The rows of one table of arriving workbooks."""
    import pandas as pd

    names = [f.split()[0] for f in TABLES[table].replace("struct<kind:string,num:double,str:string,bool:boolean,err:string>", "struct").split(", ")]

    def run(batches):
        for pdf in batches:
            made = [r for p, c in zip(pdf["path"], pdf["content"]) for r in rows(p, bytes(c), table)]
            yield pd.DataFrame(made, columns=names)

    return files.select("path", "content").mapInPandas(run, TABLES[table])
