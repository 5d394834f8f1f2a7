"""Packing against encoding every text whole, and its sequences against their law."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from trackloom.llm import packing

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("ids", T.StringType())])
ENCODER = Tokenizer.from_file(packing.TOKENIZER)
WORDS = ["the", "Étion", "naïve", "don't", "we'LL", "x²y", "ΟΔΟΣ", "éte", "a̸", "漢字かな", "\U0001f600", "1234", "--…", "İzmir", "<|endoftext|>", "a<|startoftext|>b", "ſtrange", "q" * 90]
SPACES = [" ", "\n", "\t\t", "\xa0", " ", "　", "\x1c", " \x1f ", "\x85", " ", "\r\n", "​"]


def ids_of(text):
    return ENCODER.encode(text or "", add_special_tokens=False).ids + [packing.END]


def held(spark, texts, tmp_path, **more):
    """Packs (id, text) rows and holds every piece against the ids of its text."""
    spark.createDataFrame([(i, t, "r", "s") for i, t in texts], SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs"))
    rows = [r.asDict() for r in packing.pack(spark.read.parquet(str(tmp_path / "docs")), **more).collect()]
    limit = more.get("limit", packing.LIMIT)
    want = defaultdict(int)
    for i, t in texts:
        ids = ids_of(t)
        for at, x in enumerate(ids):
            want[i, len(ids), at, x] += 1
    known = defaultdict(list)
    for i, t in texts:
        known[i].append(ids_of(t))
    sequences = defaultdict(list)
    for r in rows:
        part = next(x for x in known[r["doc_id"]] if len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"])
        for at in range(r["start"], r["start"] + r["length"]):
            want[r["doc_id"], len(part), at, part[at]] -= 1
        sequences[r["sequence_id"]].append(r)
    assert not any(want.values())
    for s in sequences.values():
        s.sort(key=lambda r: r["offset"])
        end = 0
        for r in s:
            assert r["offset"] == end and r["length"] > 0
            end += r["length"]
        assert end <= limit and end == s[0]["sequence_tokens"] and end & (end - 1) == 0 or end == limit
        assert s[0]["sequence_cost"] == pytest.approx(sum(packing.cost(r["length"], more.get("width", packing.WIDTH)) for r in s))
    return rows, sequences


def test_runs_encode_as_whole_texts():
    random.seed(3)
    ids = packing.Ids(packing.TOKENIZER)
    for _ in range(400):
        text = "".join(random.choice(WORDS) + random.choice(SPACES) * random.randint(0, 2) for _ in range(random.randint(0, 40)))
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == ENCODER.encode(text, add_special_tokens=False).ids, text


def test_every_plain_character():
    random.seed(4)
    ids = packing.Ids(packing.TOKENIZER)
    plain = [chr(c) for c in range(33, 0x20C0) if packing.PLAIN.fullmatch(chr(c))]
    assert len(plain) > 600
    for c in plain:
        for text in (c, "a" + c, c + "b", c + c + "1" + c, "'" + c, "Σ" + c):
            assert np.frombuffer(ids.of(text), ids.kind).tolist() == ENCODER.encode(text, add_special_tokens=False).ids, text
    for _ in range(3000):
        text = "".join(random.choice(plain if random.random() < 0.7 else "'sStTreEvmldABC<|>|_0²") for _ in range(random.randint(1, 12)))
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == ENCODER.encode(text, add_special_tokens=False).ids, text


def test_another_kind_of_file_encodes_texts_whole():
    path = packing.public_tokenizers.path("byte_bpe_50k.json")
    ids, other = packing.Ids(path), Tokenizer.from_file(path)
    for text in ("two  spaces and\nlines", " lead", ""):
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == other.encode(text, add_special_tokens=False).ids


def test_a_full_memo_starts_again(monkeypatch):
    monkeypatch.setattr(packing, "MEMO", 5)
    ids = packing.Ids(packing.TOKENIZER)
    for text in ("a b c d", "e f a b", "g h i j k l m n o a b", "a"):
        assert np.frombuffer(ids.of(text), ids.kind).tolist() == ENCODER.encode(text, add_special_tokens=False).ids


def test_nulls_repeats_long_texts_and_clashing_names(spark, tmp_path):
    texts = [(1, None), (2, ""), (3, " \n "), (None, "no id"), (None, None), (7, "same row"), (7, "same row"), (7, "another"), (8, "word " * 30_000), (2**62 + 1, "x" * 5000)]
    rows, _ = held(spark, texts, tmp_path)
    assert len({r["sequence_id"] for r in rows}) >= 8  # the long text alone fills seven


def test_small_sequences_and_many_groups(spark, tmp_path):
    random.seed(5)
    texts = [(k, " ".join(random.choice(WORDS) for _ in range(int(random.paretovariate(0.7)) % 300))) for k in range(200)]
    rows, sequences = held(spark, texts, tmp_path, limit=64, width=8, group_tokens=2000)
    assert len({s >> 32 for s in sequences}) > 3
    assert len(rows) <= sum(-(-len(ids_of(t)) // 64) for _, t in texts) + len(sequences)  # at most a cut for each sequence


def test_an_empty_table(spark, tmp_path):
    rows, _ = held(spark, [], tmp_path)
    assert rows == []


def test_costs_are_levelled():
    random.seed(9)
    lengths = [random.choice((8, 30, 120, 700, 1300)) for _ in range(3000)]
    placed, costs = packing.deal(lengths, 4096, 64)
    assert sum(p[2] for p in placed) == sum(lengths)
    full = [c for c, r in zip(costs, packing.rooms(sum(lengths), 4096)) if r == 4096]
    fitted = []  # first fit, longest first
    for n in sorted(lengths, reverse=True):
        at = next((x for x in fitted if x[0] >= n), None)
        if at is None:
            fitted.append(at := [4096, 0.0])
        at[0] -= n
        at[1] += packing.cost(n, 64)
    assert np.std(full) < 0.5 * np.std([c for _, c in fitted])


@pytest.mark.parametrize("lengths", [[], [1], [5, 5, 5], [8, 8, 1], [3] * 7, [7, 6, 5, 4, 3, 2, 1]])
def test_deal_places_every_token_once(lengths):
    placed, _ = packing.deal(lengths, 8, 4)
    seen = sorted((k, b + i) for k, b, n, _, _ in placed for i in range(n))
    assert seen == [(k, i) for k, n in enumerate(lengths) for i in range(n)]
    used = sorted((j, o + i) for _, _, n, j, o in placed for i in range(n))
    assert used == [(j, i) for j, n in enumerate(packing.rooms(sum(lengths), 8)) for i in range(n)]
