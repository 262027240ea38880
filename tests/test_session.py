import os

import pytest

from spliceframe import session


def test_staged_and_discarded(spark):
    df = session.staged(spark.range(5), "t")
    path = df.inputFiles()[0].replace("file://", "")
    assert df.count() == 5 and os.path.exists(path)
    session.discard(df)
    assert not os.path.exists(path)


class _Session:
    """Stands for a session whose cluster names the folder."""

    class conf:
        get = staticmethod({"spark.checkpoint.dir": "hdfs://n/shared/"}.get)


def test_the_session_names_the_folder():
    assert session.shared_folder(_Session) == "hdfs://n/shared"


def test_a_cluster_without_a_folder_is_refused():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://n:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster)


def test_folders_by_column(spark):
    df = session.staged(spark.range(10).selectExpr("id", "id % 2 AS part"), "t", "part")
    assert df.columns == ["id", "part"] and df.where("part = 1").count() == 5
    path = df.inputFiles()[0].replace("file://", "").rsplit("/", 2)[0]
    session.discard(df)
    assert not os.path.exists(path)


def test_clear(spark):
    path = session.staged(spark.range(1), "t").inputFiles()[0].replace("file://", "")
    session.clear(spark)
    assert not os.path.exists(path)


def test_size_check(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS t")
    assert session.small_enough(df) and not session.small_enough(df, rows=99) and not session.small_enough(df, size=5000)
    assert session.small_enough(df.limit(0))
