from types import SimpleNamespace

import pytest

from kindred.session import shared_folder


def fake(master, named=None, have=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context.have, have=have)
    context.setCheckpointDir = lambda path: setattr(context, "have", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named))


def test_a_cluster_without_a_shared_folder_is_refused():
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            shared_folder(fake(master))


def test_the_folder_that_the_session_names_is_used():
    assert shared_folder(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert shared_folder(fake("yarn", None, "hdfs:///given")) == "hdfs:///given"
    spark = fake("local[4]")
    assert shared_folder(spark) == spark.sparkContext.have
