import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from trailgraph.runtime import release  # noqa: E402
from trailgraph.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", master="local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    release(s)
    s.stop()


@pytest.fixture()
def tree(spark):
    """Source tree of {path: content}."""
    def make(files: dict):
        return spark.createDataFrame(list(files.items()), "path string, content string")

    return make


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)
