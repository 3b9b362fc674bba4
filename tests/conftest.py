import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from askloom.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))}
    session = build_session("askloom-tests", "local[4]", 4, **conf)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def elements(spark):
    """Build a one-document DataFrame from (type, text, level, page) tuples."""
    def make(*items, doc_id=1):
        from askloom.schemas import ELEMENTS
        rows = [(i, t, x, lv, p) for i, (t, x, lv, p) in enumerate(items)]
        return spark.createDataFrame([(doc_id, rows)], f"doc_id bigint, elements {ELEMENTS}")
    return make
