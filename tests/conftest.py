import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from bibliodyne.session import builder

    session = builder("tests", "4").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
