import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"


def compare(spark, queries, sql, names):
    """Runs queries on the smallest tables against their SQL."""
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    flat = lambda rows: sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in rows)
    wrong = []
    for name in names:
        df = queries[name](spark, DATA)
        cols = sorted(df.columns)
        mine = flat(tuple(r) for r in df.select(*cols).collect())
        theirs = flat(con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({sql[name]})").fetchall())
        if mine != theirs:
            wrong.append(name)
    return wrong
