"""What each stage keeps, against plain Python; repeated and null ids, clashing column names."""

import random
from collections import Counter

import corpus_pipeline as P

CLASH = ("times", "gone_id", "mix_id", "copy", "ka", "kb", "size", "shard", "slot", "kept", "who")


def frame(spark, rows):
    """rows: (doc_id, text, lang, source); every clashing name is a column too, ``n`` numbers the rows."""
    schema = "doc_id long, text string, lang string, source string, n long, " + ", ".join(f"{c} string" for c in CLASH)
    return P.cut(spark.createDataFrame([(*r, i, *(c + str(i) for c in CLASH)) for i, r in enumerate(rows)], schema))


def numbers(df):
    """The rows' numbers with their counts; every other column must still be the row's own."""
    got = df.collect()
    assert all(r[c] == c + str(r.n) for r in got for c in CLASH)
    return Counter(r.n for r in got)


def sentence(rng, n, vocab):
    return " ".join(rng.choice(vocab) for _ in range(n))


EN = "the people of this house and water with that from where they have been years ago".split()
DE = "die leute von diesem haus und wasser mit dem aus woher sie waren jahre lang nicht".split()


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_language_id_keeps_texts_in_known_languages(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, 30, EN), "en", "a") for i in range(40)] + [(100 + i, sentence(rng, 30, DE), "de", "a") for i in range(40)]
    rows += [(None, None, None, None), (500, "", "en", "a"), (500, " 12 -- 34 ", None, "a"), (None, sentence(rng, 30, EN), None, "b"), (3, sentence(rng, 30, DE), None, "b")]
    assert numbers(P.language_id(spark, frame(spark, rows), "")) == Counter(i for i in range(len(rows)) if i not in (80, 81, 82))


def test_near_dedup_keeps_one_row_of_each_group(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(500)]
    base = [sentence(rng, 60, vocab) for _ in range(12)]
    rows = [(1, base[0], "en", "a"), (2, base[0], "en", "a"), (2, base[1], "en", "a")]  # the second row of id 2 is no copy
    rows += [(None, base[2], "en", "a"), (None, base[2], "en", "a"), (None, base[3], "en", "a"), (7, base[3] + " more", "en", "a")]
    rows += [(9, base[4], "en", "a")] * 3 + [(None, None, "en", "a"), (None, "", "en", "a"), (4, " ", "en", "a")]
    rows += [(20 + i, " ".join(b.split()[: 60 - i % 4]), "en", "a") for i, b in enumerate(base[4:] * 2)]
    sets = [shingles(t or "") for _, t, _, _ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                group = [group[j] if g == group[i] else g for g in group]
    got = numbers(P.minhash_neardup(spark, frame(spark, rows), ""))
    assert set(got.values()) == {1} and sorted(group[i] for i in got) == sorted(set(group))
    for i in got:  # the smallest id of its group, null ids last
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        assert rows[i][0] == (min(ids) if ids else None)


def test_decontamination_drops_rows_with_items(spark, tmp_path):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(500)]
    item = sentence(rng, 40, vocab)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, sentence(rng, 50, vocab), "en", "a"), (1, "x y " + item, "en", "a"), (None, item, "en", "a"), (None, sentence(rng, 50, vocab), "en", "a"), (5, None, "en", "a")]
    assert numbers(P.decontamination(spark, frame(spark, rows), str(tmp_path))) == Counter((0, 3, 4))


def test_mixing_copies_follow_what_the_mix_takes(spark):
    rng = random.Random(4)
    rows = [(i if i % 3 else None, sentence(rng, rng.randint(1, 40), EN), "en", "big") for i in range(150)]
    rows += [(i % 5, sentence(rng, 10, EN), "en", "mid") for i in range(30)] + [(900, "a b", "en", None), (901, None, "en", "mid")]
    docs = frame(spark, rows)
    got = numbers(P.mix_sources(spark, docs, ""))
    assert got == numbers(P.mix_sources(spark, docs, ""))
    size = [len((t or "").split()) for _, t, _, _ in rows]
    assert got[len(rows) - 1] == 1 and max(got.values()) <= 2
    total = sum(size)
    words = Counter()
    for i, n in got.items():
        words[rows[i][3]] += n * size[i]
    caps = {s: 2 * sum(z for z, r in zip(size, rows) if r[3] == s) for s in ("big", "mid", None)}
    target = {"mid": min(caps["mid"], 2 / 8 * 1.5 * total), None: caps[None]}
    target["big"] = min(caps["big"], 1.5 * total - target["mid"] - target[None])
    assert words[None] == caps[None]  # capped at twice its size: every copy is certain
    assert abs(words["big"] - target["big"]) < 0.2 * target["big"] and abs(words["mid"] - target["mid"]) < 0.2 * target["mid"]


def test_sharding_keeps_every_row(spark):
    rows = [(i % 7 if i % 2 else None, f"text {i % 40}", "en", "a") for i in range(300)]
    docs = frame(spark, rows)
    out = P.shard(spark, docs, "").collect()
    assert Counter(r.n for r in out) == Counter(range(300))
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_mixing_does_not_depend_on_files(spark, tmp_path):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows = [(rng.choice([None, *range(300)]), sentence(rng, rng.randint(0, 40), vocab), rng.choice(["en", None]), rng.choice(["a", "b", "c", None])) for _ in range(400)]
    rows += rows[:60] + [(7, "the same row again and again", "en", "a")] * 150
    got = []
    for n in (1, 3, 8):
        path = str(tmp_path / f"files{n}")
        mixed = list(rows)
        random.Random(n).shuffle(mixed)
        spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string").repartition(n).write.parquet(path)
        got.append(Counter(tuple(r) for r in P.mix_sources(spark, spark.read.parquet(path), "").collect()))
    assert got[0] == got[1] == got[2] and sum(got[0].values()) > 400
