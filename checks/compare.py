"""Run the queries on Spark and DuckDB and compare rows: python -m checks.compare FOLDER [NAME ...]"""

from __future__ import annotations

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return f"{value + 0.0:.12g}"
    return str(value)


def rows_by_column_name(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both sides agree, otherwise a short description."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = result.fetchall()
    actual = [tuple(row) for row in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} instead of {sorted(names)}"
    a = rows_by_column_name(spark_df.columns, actual)
    b = rows_by_column_name(names, expected)
    if len(a) != len(b):
        return f"{len(a)} rows instead of {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {sorted(names)}: {bad[0][0]} instead of {bad[0][1]}" \
        if bad else None


def main(folder: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    from checks import duckdb_sql, spark_queries

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection = oracle(folder)
    failed = 0
    for name in names or spark_queries.QUERIES:
        start = time.time()
        try:
            df = spark_queries.QUERIES[name](spark, folder)
            sql = duckdb_sql.QUERIES.get(name)
            problem = difference(df, connection, sql) if sql else None
            note = "" if sql else f" (no SQL, {df.count()} rows)"
        except Exception as error:  # report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        failed += problem is not None
        print(f"{name:28s} {time.time() - start:6.1f} s  {problem or 'ok' + note}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) and 1)
