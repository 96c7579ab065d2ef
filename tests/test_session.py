"""What executors get, and where tables may go when no shared folder is named."""

import os
import subprocess
import sys

import pytest

from inspectlake import session
from inspectlake.sinks import tables as sk


def test_package_runs_from_its_zip(tmp_path):
    path = session.packed(str(tmp_path))
    code = "import inspectlake.operators.tiles, inspectlake.operators.gate, inspectlake; print(inspectlake.__file__)"
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": path}, cwd=tmp_path, capture_output=True, text=True, check=True)
    assert out.stdout.strip().startswith(path)


@pytest.mark.parametrize("master,allowed", [("local", True), ("local[4]", True), ("local-cluster[2,1,1024]", False), ("yarn", False)])
def test_a_cluster_needs_a_shared_folder(master, allowed):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    if allowed:
        assert sk.shared_folder(Session())
    else:
        with pytest.raises(ValueError):
            sk.shared_folder(Session())
