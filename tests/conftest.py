import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from flowtally.session import local_session
    os.chdir(tmp_path_factory.mktemp("elsewhere"))  # the workers do not find the package by themselves
    s = local_session("tests", "8", 4, {"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    yield s
    s.stop()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)
