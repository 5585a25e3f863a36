"""One local session for all tests."""

import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path[:0] = [ROOT, str(Path(__file__).resolve().parent)]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

import pytest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siltstone.session import local_session

    folder = f"file://{tmp_path_factory.mktemp('checkpoints')}"
    session = local_session(cores=4, partitions=4, **{"spark.driver.memory": "3g", "spark.checkpoint.dir": folder})
    session.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('rdd')}")
    return session


@pytest.fixture(scope="session")
def sf():
    return SF
