"""Where intermediate tables go."""

import pytest

from rillstone import scratch


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = Conf(conf), self
        self.master, self.getConf = master, lambda: Conf()


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_dir(Session(master))
    assert scratch.shared_dir(Session("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_may_do_without(master):
    s = Session(master)
    made = scratch.shared_dir(s)
    assert made.startswith("file:///") and scratch.shared_dir(s) == made
    scratch._made.pop(made)
