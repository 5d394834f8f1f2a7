"""Very long texts, ties and clashing names in near-duplicate groups."""

import random

from pyspark.sql import functions as F

from trackloom.llm import neardup


def test_very_long_texts(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = list(words)
    for k in rng.sample(range(len(near)), 3000):
        near[k] = "changed"
    far = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    rows = [(3, " ".join(words)), (1, " ".join(near)), (2, " ".join(far)), (4, "x" * 3_000_000), (5, "x" * 3_000_000 + " y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ka": F.lit("clash"), "cid": F.lit(1), "sketch": F.lit("s")})
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {3: (1, False), 1: (1, True), 2: (2, True), 4: (4, True), 5: (5, True)}
    assert neardup.one_of_each(df).count() == 4 and neardup.one_of_each(df).columns == df.columns
