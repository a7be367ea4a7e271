from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tablesmith import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mixed(spark):
    """Golden input (fixed values): four rows with every currency, flag and date style, whose cleaned form is known."""
    return spark.createDataFrame(
        [
            ("A001", "2024-07-01", "2024-07-02 10:00:00", "₩ 1,234", "서울", "예", None),
            ("A001", "2024/07/01", "2024-07-02 09:00:00", "KRW 1,234", "서울", "Y", None),
            ("A002", "2024.07.03", "2024-07-04 12:30:00", "12,000원", "부산", "N", None),
            ("A003", "07/05/2024", "2024-07-06 08:00:00", "-3,500", "대구", "False", None),
        ],
        "`거래ID` string, `주문일` string, `업데이트일` string, `금액` string, `도시` string, `활성` string, `메모` string",
    )


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
