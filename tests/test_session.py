import os
from types import SimpleNamespace

import pytest

from lotusgrid import session


def test_cluster_without_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    for master in ("spark://a:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://a"):
        with pytest.raises(ValueError, match="checkpoint"):
            session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))


def test_cuts_are_dropped(spark):
    df = session.cut(spark.range(5).selectExpr("id as x"), "try")
    (at,) = {os.path.dirname(f.removeprefix("file:").replace("///", "/")) for f in df.inputFiles()}
    assert df.count() == 5 and os.path.isdir(at)
    session.drop_cuts(spark)
    assert not os.path.exists(at)


def test_spread_never_lowers_the_number_of_partitions(spark):
    assert session.spread(spark.range(100, numPartitions=9), "id").rdd.getNumPartitions() == 9
    assert session.spread(spark.range(100, numPartitions=50), "id").rdd.getNumPartitions() == 50
    assert session.spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == 2 * session.parallelism(spark)
