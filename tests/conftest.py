import pytest

from faultline.session import CHUNK_CONF, get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def small_chunks(spark):
    """Cut builds into chunks of a few lines, so that every scan crosses borders."""
    spark.conf.set(CHUNK_CONF, "7")
    yield spark
    spark.conf.unset(CHUNK_CONF)


@pytest.fixture
def log(spark):
    """A log table from texts, one build each."""

    def make(*texts):
        rows = [(b + 1, n + 1, line) for b, t in enumerate(texts) for n, line in enumerate(t.split("\n"))]
        return spark.createDataFrame(rows, "build_id bigint, line_no bigint, line string")

    return make
