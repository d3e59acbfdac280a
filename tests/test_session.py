from types import SimpleNamespace

import pytest

from gridseries.session import shared_folder


def session(master, folder=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: folder))


def test_shared_folder_is_needed_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
        assert shared_folder(session(master, "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[4]"))
