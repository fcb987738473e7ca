import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpus_spark.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4", shuffle_partitions=4, memory="4g")
