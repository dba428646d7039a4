from __future__ import annotations

from types import SimpleNamespace

import pytest

from citeweave import staging


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getConf(self):  # noqa: N802
        return {}

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def session(master):
    return SimpleNamespace(conf={}, sparkContext=Context(master))


def test_a_cluster_must_name_a_shared_folder():
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        staging.work_dir(session("spark://host:7077"))


def test_one_machine_gets_one_folder_of_its_own():
    own = session("local[2]")
    a, b = staging.work_dir(own), staging.work_dir(own)
    assert a != b
    assert a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] == own.sparkContext.folder


def test_staged_tables_can_be_dropped(spark):
    df = staging.staged(spark.range(10))
    assert df.count() == 10
    staging.dropped(df)
    assert not staging.few(spark.range(3), 2)
    assert staging.few(spark.range(2), 2)
