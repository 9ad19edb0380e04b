from types import SimpleNamespace

import pytest

from spanforge.llm import common


def session(master, where=None, set_dir=None):
    """As much of a session as shared_dir asks for."""
    state = {"dir": set_dir}
    option = lambda: SimpleNamespace(isEmpty=lambda: state["dir"] is None, get=lambda: state["dir"])
    context = SimpleNamespace(master=master, getConf=lambda: {}, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=option)), setCheckpointDir=lambda d: state.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: where), sparkContext=context), state


@pytest.mark.parametrize("master", ["local[4]", "local", "local-cluster[3,2,1024]", "spark://host:7077", "yarn"])
def test_shared_folder(master):
    spark, state = session(master, "hdfs:/shared")
    assert common.shared_dir(spark) == "hdfs:/shared" == state["dir"]
    spark, state = session(master, None, "file:/set")
    assert common.shared_dir(spark) == "file:/set"
    spark, state = session(master)
    if master in ("local", "local[4]"):
        assert common.shared_dir(spark) == state["dir"] and "spanforge-" in state["dir"]
    else:
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(spark)


def test_written_tables_and_small_ones(spark):
    df, path = common.written(spark.range(10).selectExpr("id", "cast(id as string) s"), "x")
    assert sorted(tuple(r) for r in df.collect()) == [(i, str(i)) for i in range(10)]
    empty, _ = common.written(df.where("id < 0"), "x")
    assert empty.columns == ["id", "s"] and empty.collect() == []
    assert common.small(df, 8, 80) is not df and common.small(df, 8, 79) is df
    common.remove(spark, path)
    with pytest.raises(Exception, match="(?i)exist|found"):
        spark.read.parquet(path).collect()
