"""Where intermediate tables may lie."""

from types import SimpleNamespace

import pytest

from lodeframe.functions.ordering import ready


def _session(master, conf):
    chosen = []
    inner = SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: not chosen))
    sc = SimpleNamespace(master=master, getConf=lambda: conf, setCheckpointDir=chosen.append, _jsc=SimpleNamespace(sc=lambda: inner))
    return SimpleNamespace(sparkContext=sc), chosen


def test_a_cluster_must_name_the_folder():
    spark, chosen = _session("spark://host:7077", {})
    with pytest.raises(ValueError):
        ready(spark)
    assert not chosen
    spark, chosen = _session("spark://host:7077", {"spark.checkpoint.dir": "hdfs:///shared"})
    ready(spark)
    ready(spark)
    assert chosen == ["hdfs:///shared"]
    spark, chosen = _session("local[2]", {})
    ready(spark)
    assert len(chosen) == 1
