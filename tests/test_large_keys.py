"""Queries over tables whose keys go beyond a sheet's rows, the calendar of a workbook or a report's limit."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gridloom.operators import cells as C
from gridloom.operators import export, graph, report


def parts(spark, folder, keys, brand):
    """A table of parts with the given keys, all of one brand."""
    rows = [(k, "large ring" if k % 3 else "hot bolt", brand, "LARGE", k % 50 + 1, 900.0 + k % 10) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return str(folder)


def both(spark, name, folder, table="part"):
    """The rows of a query and of its SQL."""
    import __spark_entry__ as e

    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    made = e.queries()[name](spark, folder)
    want = db.execute(f"SELECT {', '.join(made.columns)} FROM ({e.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, made.collect()), key=str), sorted(want, key=str)


def test_report_counts_all_formulas(spark, tmp_path):
    evaluated = spark.range(10_050).select(F.lit("w").alias("workbook_id"), F.lit(0).alias("sheet_index"), F.col("id").alias("row"), F.lit(0).alias("col"), F.lit("computed").alias("status"), F.struct(F.lit("number").alias("kind")).alias("value"))
    counted = lambda *most: [(r.computed, r.truncated) for r in report.bounded_outcomes(evaluated, *most).collect()]
    assert counted() == [(10_000, True)] and counted(None) == [(10_050, False)]
    got, want = both(spark, "report_json", parts(spark, tmp_path, range(10_050), "Brand#1"))
    assert got == want


@pytest.mark.parametrize("name", ["serial_to_date_1900", "serial_to_date_1904"])
def test_days_after_9999(spark, tmp_path, name):
    keys = [0, 1, 58, 59, 60, 422_428, 422_429, 422_430, 422_520, 1_199_999, 2_958_463, 2_958_464, 2_958_465, 2_958_466, 7_199_999]
    got, want = both(spark, name, parts(spark, tmp_path, keys, "Brand#1"))
    assert got == want


def test_violations_of_keys_beyond_the_grid(spark, tmp_path):
    keys = [3, 50, 1_048_574, 1_048_575, 1_048_576, 1_048_577, 1_048_600, 2_097_151, 2_097_153, 7_199_999]
    got, want = both(spark, "write_violations", parts(spark, tmp_path, keys, "Brand#11"))
    assert got == want and ("CellOutOfGrid", 2) in got


def test_levels_send_nothing_through_the_driver(spark, monkeypatch):
    plans, kept = [], graph._kept

    def seen(df):
        plans.append(df)
        return kept(df)

    monkeypatch.setattr(graph, "_kept", seen)
    nodes = spark.range(1, 200).withColumnRenamed("id", "node")
    edges = nodes.select("node", F.expr("node div 2").alias("needs")).where("node > 1")
    done = graph.levels(nodes, edges)
    assert {r.node: r.level for r in done.collect()} == {k: k.bit_length() - 1 for k in range(1, 200)}
    for df in [*plans, done]:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_negative_zero_is_shown_as_zero(spark):
    """As the reference has it; a bare -0 would be a field that begins with a minus and is not escaped."""
    table = spark.createDataFrame([(1, -0.0), (2, 0.0), (3, -0.01)], "k int, v double")
    cells = C.melt(table, ["v"], F.col("k"))
    assert [r.line for r in export.csv_rows(cells, escape_formulas=True).orderBy("row").collect()] == ["0", "0", "\"'-0.01\""]
