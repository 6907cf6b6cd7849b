import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from streetloom.session import session

    where = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", 4, **{"spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{where}/shared", "spark.sql.warehouse.dir": f"{where}/warehouse", "spark.ui.showConsoleProgress": "false"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
