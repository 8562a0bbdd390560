import pathlib
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[4]").appName("tests")
         .config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "6g")
         # tiny inputs: compiling code for each of many plans would take most of the time
         .config("spark.sql.codegen.wholeStage", "false")
         .config("spark.sql.adaptive.enabled", "false")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def settings(request):
    """What ``configure`` sets for a session ends with the test that called it."""
    if "spark" not in request.fixturenames:
        yield
        return
    s, names = request.getfixturevalue("spark"), ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    before = {n: s.conf.get(n) for n in names}
    yield
    for n, v in before.items():
        s.conf.set(n, v)
