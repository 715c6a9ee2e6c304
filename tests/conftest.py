import pytest
from pyspark.sql import SparkSession

from sharegate.session import ship_package


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("sharegate-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


FILES = "share_id string, path string, content binary, length long, modified timestamp, read_error string"


@pytest.fixture(scope="session")
def make_files(spark):
    """files(...) from {path: text or bytes or None}; None is an unreadable file."""

    def make(tree: dict, share: str = "s"):
        rows = []
        for path, body in tree.items():
            raw = body.encode() if isinstance(body, str) else body
            rows.append((share, path, raw, len(raw) if raw is not None else 0, None, None if raw is not None else "PermissionError"))
        return spark.createDataFrame(rows, FILES)

    return make
