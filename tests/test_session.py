"""Where intermediate tables may go."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from tidemark.session import ensure_checkpoint_dir


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def session(master, folder=None):
    return SimpleNamespace(sparkContext=Context(master), conf=SimpleNamespace(get=lambda key, default: folder or default))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(session(master))
    named = session(master, "hdfs:///shared")
    ensure_checkpoint_dir(named)
    assert named.sparkContext.folder == "hdfs:///shared"


@pytest.mark.parametrize("master", ["local", "local[*]", "local[8]"])
def test_one_machine_may_use_a_scratch_folder(master):
    own = session(master)
    ensure_checkpoint_dir(own)
    assert own.sparkContext.folder
