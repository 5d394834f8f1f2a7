"""Tables partitioned by sequence come in few files."""

from pyspark.sql import functions as F

from trackloom.operators import graph


def test_a_sequence_is_one_file_however_many_tasks_hold_it(spark, tmp_path):
    t = spark.range(400).select(F.concat(F.lit("s"), F.expr("cast(id % 4 as string)")).alias("sequence_id"), "id").repartition(8)
    for _ in range(2):
        graph.write({"t": t}, str(tmp_path))
    assert len(list(tmp_path.glob("t/sequence_id=*/*.parquet"))) == 4
    assert spark.read.parquet(f"{tmp_path}/t").count() == 400
