from types import SimpleNamespace

import pytest

from sigtrace.operators.staging import shared_folder, stage


def session(named, current=None, master="local[4]"):
    state = {"dir": current}
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: state["dir"], setCheckpointDir=lambda d: state.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named or d), sparkContext=context)


def test_the_named_folder_comes_first():
    assert shared_folder(session("s3://shared/ckpt", "/other")) == "s3://shared/ckpt"
    assert shared_folder(session(None, "hdfs:/ckpt")) == "hdfs:/ckpt"
    alone = session(None)
    assert shared_folder(alone) == shared_folder(alone) and "sigtrace-" in shared_folder(alone)


def test_staged_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "n int, t array<string>")
    again = stage(df)
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    assert spark.conf.get("spark.checkpoint.dir") in again.inputFiles()[0]


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(session(None, master=master))
