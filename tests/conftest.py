import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", f"file://{shared}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setCheckpointDir(f"file://{shared}/checkpoints")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    """Rows as sorted tuples that compare across engines."""

    def cell(v):
        if v is None or isinstance(v, float) and v != v or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return round(float(v), 6)
        if type(v).__name__.startswith("int"):
            return int(v)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(cell(v) for v in r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Compare a query with its SQL."""

    def run(query, sql):
        ours, theirs = query(spark, sf).toPandas(), duck.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        columns = sorted(ours.columns)
        a, b = plain(ours[columns].itertuples(index=False)), plain(theirs[columns].itertuples(index=False))
        assert a == b

    return run
