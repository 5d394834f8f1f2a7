"""Shared helpers: hot keys, spread keys, row keys, the shared folder."""

import pytest
from pyspark.sql import functions as F

from trackloom.llm import common


@pytest.fixture
def sides(spark):
    """A hot key with two thirds of all rows, many rare ones, one that the small side lacks, null keys."""
    rows = [(1, None, i) for i in range(2000)] + [(k, "x", k) for k in range(2, 900)] + [(-1, "x", 0), (None, "x", 0)]
    r = spark.createDataFrame(rows, "k long, extra string, i long")
    one = r.where("k > 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("payload"))
    return r, common.cut(one)


def key(df):
    return sorted((str(r.k), r.i, str(r.n), str(r.payload)) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_joined_like_others(sides, how):
    r, one = sides
    assert key(common.join_one(r, one, ["k"], "n", how)) == key(r.join(one, "k", how))
    plan = common.join_one(r, one, ["k"], "n", how)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan  # the hot key goes its own way
    few = common.cut(one.where("k > 1"))
    rows = r.where("k > 1")
    assert "Union" not in common.join_one(rows, few, ["k"], "n")._jdf.queryExecution().optimizedPlan().toString()
    assert key(common.join_one(rows, few, ["k"], "n")) == key(rows.join(few, "k"))


def test_spread_keys_meet_their_row(sides):
    r, one = sides
    r = r.where("k > 0")
    assert key(common.join_spread(r, one, "k", "i", most=100)) == key(r.join(one, "k"))


def test_row_keys_tell_repeated_rows_apart(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")] * 5 + [(None, None)] * 3, "x long, ka string")
    for df in (rows, common.cut(rows), common.cut(rows).where("x = 1 or x is null").select("ka", "x"), rows.unionByName(rows)):
        keyed = common.cut(common.keyed(df, "a", "b"))
        assert keyed.count() == df.count() == keyed.select("a", "b").distinct().count()
    rows.write.csv(str(tmp_path / "c"))
    assert common.keyed(spark.read.csv(str(tmp_path / "c")), "a", "b").select("a", "b").distinct().count() == 8
    table = common.cut(rows)
    one, two = (sorted((r.a, r.b, str(r.x)) for r in common.keyed(t, "a", "b").collect()) for t in (table, table.select("x", "ka")))
    assert one == two


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", spark.sparkContext.applicationId

        def __getattr__(self, name):
            return getattr(spark.sparkContext, name)

        class _jsc:
            @staticmethod
            def sc():
                return type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))})

        @staticmethod
        def getConf():
            return type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    monkeypatch.setattr(common, "ship", lambda s: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.ensure_checkpoint_dir(Session())
