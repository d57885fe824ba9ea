import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from strandline.session import get_spark


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
                                                "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
