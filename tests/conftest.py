import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry.session import get_session

    s = get_session("local[4]", "quarry-tests", shuffle_partitions=8,
                    extra_conf={"spark.ui.enabled": "false",
                                "spark.ui.showConsoleProgress": "false",
                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="quarry-ck-"),
                                "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="quarry-wh-")})
    s.sparkContext.setLogLevel("ERROR")
    yield s
