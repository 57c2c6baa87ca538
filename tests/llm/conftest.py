import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session", autouse=True)
def workers_know_the_package(spark):
    from gapscan.llm.common import known_to_workers

    known_to_workers(spark)
