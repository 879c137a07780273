"""The shared folder and the tables in it."""

from types import SimpleNamespace

import pytest

from gleanery import scratch


class Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


def _session(master, folder=None):
    conf = Conf({"spark.checkpoint.dir": folder} if folder else {})
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId=master, getConf=Conf))


def test_only_a_local_master_gets_a_local_folder():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[3,2,1000]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            scratch.shared_folder(_session(master))
        assert scratch.shared_folder(_session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch.shared_folder(_session("local[4]")).startswith("file:///")


def test_release_deletes_what_is_left(spark):
    kept = scratch.Scratch(spark).keep(spark.range(3))
    path = next(p for p in scratch._LEFT)
    assert kept.count() == 3
    scratch.release(spark)
    assert not scratch._LEFT
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
