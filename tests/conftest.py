import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wordloom.session import ensure_checkpoint_dir, local_session  # noqa: E402

SMALL_SF = "/root/testdata/sf0.001"
MID_SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", shuffle_partitions=8, app="wordloom-tests")
    ensure_checkpoint_dir(s)  # the session's spark.checkpoint.dir, or a scratch folder if unset
    yield s
    s.stop()


@pytest.fixture(scope="session")
def dictionary(spark):
    from wordloom.sources.dictionary import load_dictionary

    return load_dictionary(spark)


@pytest.fixture(scope="session")
def normalizer(dictionary):
    from wordloom.operators.normalize import Normalizer

    return Normalizer(dictionary)
