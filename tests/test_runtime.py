from __future__ import annotations

import pytest

from ratescope import runtime


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, configured=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}


def test_cluster_setting_comes_first():
    session = Session("yarn", "hdfs:///shared")
    assert runtime.shared_dir(session) == "hdfs:///shared" == session.sparkContext.folder
    assert runtime.scratch_path(session, "x").startswith("hdfs:///shared/x-")


def test_folder_of_the_context_is_kept():
    assert runtime.shared_dir(Session("yarn", None, "hdfs:///set")) == "hdfs:///set"


def test_cluster_without_setting_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session("spark://host:7077"))


def test_local_master_gets_a_folder_once():
    session = Session("local[2]")
    first = runtime.shared_dir(session)
    assert first.startswith("/tmp/spark-") and runtime.shared_dir(session) == first


def test_settled_table_equals_its_source(spark, rows):
    df = spark.range(100).selectExpr("id", "id % 7 AS k", "array(id) AS a")
    settled = runtime.settle(df)
    assert settled.dtypes == df.dtypes and rows(settled) == rows(df)
