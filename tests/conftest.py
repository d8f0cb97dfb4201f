import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", str(folder / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def data():
    return DATA


def _text(v):
    import numpy as np

    if isinstance(v, (list, tuple, np.ndarray)):
        return "[" + ",".join(map(_text, v)) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_text(x)}" for k, x in v.items()) + "}"
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def same_as_oracle(spark, data):
    """A function that runs a query and its SQL and compares their rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")

    def check(run, sql):
        df = run(spark, data)
        names = sorted(df.columns)
        ours = sorted([_text(r[c]) for c in names] for r in df.collect())
        found = con.execute(sql)
        cols = [x[0] for x in found.description]
        theirs = sorted([_text(r[cols.index(c)]) for c in sorted(cols)] for r in found.fetchall())
        assert sorted(cols) == names
        assert ours == theirs

    return check
