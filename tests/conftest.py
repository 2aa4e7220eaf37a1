import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from unitflow.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "unitflow-tests",
        "local[8]",
        spark__sql__shuffle__partitions=8,
        spark__driver__memory="6g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("UNITFLOW_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


def rows(df, *columns):
    """Rows of a DataFrame as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def executed_plan(df):
    """The physical plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )
