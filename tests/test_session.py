from types import SimpleNamespace

import pytest

from docattr import session

WAREHOUSE = {"spark.sql.warehouse.dir": "hdfs://store/warehouse/"}


def stub(master, conf, checkpoint=None):
    """What ``shared_dir`` asks of a session; a cluster cannot be started inside the tests' own session."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, *default: conf.get(key, *default)),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint))


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn"])
@pytest.mark.parametrize("conf, checkpoint, folder", [
    ({"spark.checkpoint.dir": "/shared/checkpoints"}, None, "/shared/checkpoints"),
    ({"spark.checkpoint.dir": "hdfs://store/c/"}, None, "hdfs://store/c"),
    ({}, "file:/shared/of-context", "file:/shared/of-context"),
    ({}, None, "hdfs://store/warehouse/docattr-scratch"),
])
def test_a_cluster_has_a_shared_folder(master, conf, checkpoint, folder):
    assert session.shared_dir(stub(master, conf | WAREHOUSE, checkpoint)) == folder


def test_a_local_session_keeps_its_folder(spark):
    assert session.shared_dir(spark) == session.shared_dir(spark)
