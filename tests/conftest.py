import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from folium.session import local_session

    local = tmp_path_factory.mktemp("spark")
    s = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.local.dir": str(local), "spark.sql.warehouse.dir": str(local / "warehouse"), "spark.checkpoint.dir": f"file://{local}/checkpoints"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return str(TESTDATA / "sf0.001")


@pytest.fixture(scope="session")
def duck():
    """A function (sql, folder) -> rows of DuckDB over the parquet tables of a folder."""
    import duckdb

    def run(sql: str, folder: str):
        con = duckdb.connect()
        for t in TABLES:
            path = Path(folder, f"{t}.parquet")
            if path.exists():
                con.sql(f"create view {t} as select * from '{path / '*.parquet' if path.is_dir() else path}'")
        return con.sql(sql).df()

    return run


def rows_of(frame):
    """Sorted rows of a pandas frame, columns by name, nulls as None."""
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=str)
