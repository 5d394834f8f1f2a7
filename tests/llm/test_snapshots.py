"""Snapshot difference against plain Python over whole tables."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import types as T

from trackloom.llm import snapshots

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("side", T.StringType()), T.StructField("SALT", T.StringType())])
NULL = "~"


def known(key):
    return (key is not None, key or 0)


def digest(row):
    one = [b"\x00" if x is None else b"\x01" + hashlib.sha256(x.encode()).digest()[:16] for x in row[1:]]
    return hashlib.sha256(b"".join(one)).digest()[:16]


def verdict(a, b, rekey):
    changed = ",".join(c for c, x, y in zip(snapshots.COLUMNS, a[1:], b[1:]) if x != y)
    sha = hashlib.sha256("\n".join(NULL if x is None else x for x in b[1:]).encode()).hexdigest()
    return b[0], a[0], "rekey" if rekey else "update" if changed else "same", changed, sha


def difference(earlier, later):
    out, left = [], ([], [])
    keys = defaultdict(lambda: ([], []))
    for side, rows in enumerate((earlier, later)):
        for r in rows:
            keys[r[0]][side].append(r)
    for a, b in keys.values():
        a.sort(key=digest), b.sort(key=digest)
        out += [verdict(x, y, False) for x, y in zip(a, b)]
        n = min(len(a), len(b))
        left[0].extend(a[n:]), left[1].extend(b[n:])
    contents = defaultdict(lambda: ([], []))
    for side in (0, 1):
        for r in left[side]:
            contents[r[1:]][side].append(r)
    for a, b in contents.values():
        a.sort(key=lambda r: known(r[0])), b.sort(key=lambda r: known(r[0]), reverse=True)
        out += [verdict(x, y, True) for x, y in zip(a, b)]
        n = min(len(a), len(b))
        out += [(x[0], x[0], "delete", "", None) for x in a[n:]]
        out += [(y[0], None, "insert", "", verdict((None, *y[1:]), y, False)[4]) for y in b[n:]]
    return out


def held(spark, earlier, later, n):
    frames = [spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(n) for rows in (earlier, later)]
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        got = [tuple(r) for r in snapshots.compare(*frames).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(str, got)) == sorted(map(str, difference(earlier, later)))
    return got


def changed(rows, rng):
    out = []
    for r in rows:
        key, text, lang, source = r
        out += rng.choice(([], [r], [r], [r], [(key, (text or "") + "+", lang, source)], [(key, text, source, lang)], [(-1 - (key or 0), text, lang, source)], [r, (-1 - (key or 0), text, lang, source)]))
    rng.shuffle(out)
    return out


def test_random_tables_with_nulls_and_repeated_keys(spark):
    rng = random.Random(1)
    some = lambda *x: rng.choice(x)
    rows = [(some(None, *range(60)), some(None, "", "a", "b", "~", "long " * 2000), some(None, "en", "de"), some(None, "web", "~")) for _ in range(300)]
    held(spark, rows, changed(rows, rng), 5)


def test_unique_keys_and_extreme_ones(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("abcdefgh"), "en", "web") for k in range(400)] + [(2**63 - 1, "x", None, None), (-(2**63), "x", None, None)]
    got = held(spark, rows, changed(rows, rng) + [(2**63 - 2, "x", None, None)], 7)
    assert {r[2] for r in got} == {"same", "update", "rekey", "insert", "delete"}


def test_one_content_and_one_key_hold_most_rows(spark):
    same = [(k, "copy", "en", "web") for k in range(700)]
    moved = [(-1 - k, "copy", "en", "web") for k in range(650)]
    one_key = [(5000, f"{k % 9}", "en", "web") for k in range(300)]
    held(spark, same + one_key, moved + one_key[:280] + [(None, "copy", "en", "web")], 6)


def test_a_hot_group_is_spread(spark):
    rows = spark.sparkContext.parallelize([(k, k % 2, b"same", (b"t",), None, k) for k in range(4000)], 4)
    placed = snapshots.dealt(rows, 8, 4000, snapshots._content_group)
    sizes = placed.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert max(sizes) < 3 * 4000 / 8 and sum(sizes) == 4000
    pairs = snapshots.pair_by_rank(rows, 8, 4000, snapshots._content_group)
    assert max(pairs.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) < 3 * 2000 / 8
    got = {(a[0], b[0]) for kind, a, b in pairs.collect()}
    assert got == set(zip(range(0, 4000, 2), range(3999, 0, -2)))


def test_empty_tables(spark):
    rows = [(1, "a", "en", None), (None, None, None, None)]
    assert held(spark, [], [], 3) == []
    assert {r[2] for r in held(spark, [], rows, 3)} == {"insert"}
    assert {r[2] for r in held(spark, rows, [], 3)} == {"delete"}


def test_the_later_snapshot(spark):
    rows = [(k, f"t{k}" if k % 7 else None, "en", "web") for k in range(100)] + [(None, "n", "en", "web")]
    got = [tuple(r) for r in snapshots.later_snapshot(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()]
    want = []
    for k, t, lang, source in rows:
        hit = 9 if k is None else zlib.crc32(str(k).encode()) % 10
        if hit == 0:
            continue
        want.append({1: (k, (t or "") + "+", lang, source), 2: (k, t, source, lang), 3: (-1 - (k or 0), t, lang, source), 4: (-1 - (k or 0), t, lang, None)}.get(hit, (k, t, lang, source)))
        if hit == 5:
            want.append((-1 - k, t, lang, source))
    assert sorted(map(str, got)) == sorted(map(str, want))
