"""Rows of a Spark query against those of its SQL in DuckDB."""
import glob
import os
import sys

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"create view {name} as select * from '{source}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for values in frame.itertuples(index=False):
        row = []
        for v in values:
            if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
                row.append("null")
            elif isinstance(v, float):
                row.append(f"{v:.6f}")
            else:
                row.append(str(v))
        out.append(tuple(row))
    return sorted(out)


def differences(spark, con, function, sql, sf_dir):
    got, expected = rows(function(spark, sf_dir).toPandas()), con.sql(sql).df()
    expected = rows(expected)
    return len(got), [x for x in got if x not in expected][:3] if len(got) < 5000 else (got != expected), len(expected), got == expected


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    sf = sys.argv[1]
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    con, sql = connect(sf), entry.oracle_sql()
    for name, function in entry.queries().items():
        if name in sql and (len(sys.argv) < 3 or name in sys.argv[2:]):
            try:
                n, diff, m, same = differences(session, con, function, sql[name], sf)
                print("ok  " if same else "DIFF", name, n, m, "" if same else diff)
            except Exception as error:  # noqa: BLE001
                print("FAIL", name, str(error)[:400].replace("\n", " "))
