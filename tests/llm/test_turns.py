"""Conversation repair against trying every audit, and pieces against whole conversations."""

import hashlib
import itertools
import random
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import types as T

from trackloom.llm import turns

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("gone", T.BooleanType()), T.StructField("piece", T.StringType())])
sys.setrecursionlimit(100_000)
COSTS = {"K": 0, "R": 1, "D": 2, "I": 5}


def valid(roles: str) -> bool:
    rest = roles[1:] if roles[:1] == "s" else roles
    return not roles or bool(rest) and rest == "ua" * (len(rest) // 2)


def every_audit(rows):
    """(cost, audit, lines) of the best of all audits with few insertions, by trial; rows: (role, text, fault)."""
    best = None
    for inserts in range(3):
        for audit in set(itertools.product("KRDI", repeat=len(rows) + inserts)):
            if audit.count("I") != inserts:
                continue
            for said in itertools.product("ua", repeat=sum(x in "RI" for x in audit)):
                said, at, cost, roles, lines = iter(said), iter(rows), 0, "", []
                for x in audit:
                    role, text, fault = next(at) if x != "I" else ("", "", 0)
                    cost += COSTS[x] + (5 if fault == 3 and x != "D" else 0)
                    if x in "KR" and fault in (1, 2):
                        cost = 10**9
                    if x != "D":
                        who = role if x == "K" else {"u": "user", "a": "assistant"}[next(said)]
                        roles += who[:1] or "?"
                        lines.append(f"{who}:{text}")
                if cost < 10**9 and valid(roles):
                    best = min(x for x in (best, (cost, "".join(audit), lines)) if x)
    return best


def reference(rows):
    """RESULT by recursion from the first row on; rows: (turn, role, text) in order."""
    seen, steps = set(), []
    for _, role, text in rows:
        body = text.strip(turns.WHITE)
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        steps.append((role, text, fault))

    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(steps) and state in "-a":
            options.append((0, "", ()))

        def go(cost, letter, line, then):
            if then[1] is not None:
                c, a, lines = best(*then)
                options.append((cost + c, letter + a, line + lines))

        after = lambda who: {"-s": "s", "-u": "u", "su": "u", "au": "u", "ua": "a"}.get(state + who)
        if inserted < 2:
            for who in ("user", "assistant"):
                go(5, "I", (f"{who}:",), (i, after(who[0]), inserted + 1))
        if i < len(steps):
            role, text, fault = steps[i]
            go(2, "D", (), (i + 1, state, 0))
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                go(more, "K", (f"{role}:{text}",), (i + 1, after(role[:1]) if role[:1] in ("s", "u", "a") else None, 0))
                for who in ("user", "assistant"):
                    go(1 + more, "R", (f"{who}:{text}",), (i + 1, after(who[0]), 0))
        return min(options) if options else (10**9, "", ())

    cost, audit, lines = best(0, "-", 0)
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum((a[:1], b[:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for (_, a, _), (_, b, _) in itertools.pairwise(rows))
    return gaps, *(sum(f == k for _, _, f in steps) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def rows_of(n, rng):
    roles, texts = ["user", "assistant", "system", "tool", "", "u", " "], ["Yes.", "No!", "and then", " ", "", "Why?\n", "Étion", "\x0b", "ok.\xa0"]
    return [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles[: rng.choice((2, 3, 7))]), rng.choice(texts[: rng.choice((2, 3, 9))]) + rng.choice(("", str(rng.randint(0, 99)) + "."))) for _ in range(n)]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def held(spark, rows, parts, tmp_path, **more):
    """``rows``: (conv_id, turn, role, text, gone)."""
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "rows"))
    found = turns.repair(spark.read.parquet(str(tmp_path / "rows")), **more)
    assert found.columns == ["conv_id", *turns.NAMES]
    collected = found.collect()
    got = {r[0]: tuple(r[1:]) for r in collected}
    assert len(got) == len(collected)
    want = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x, gone in rows if c == conv and not gone]
        want[conv] = reference(order(own)) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_small_conversations_against_all_audits(seed):
    rng = random.Random(seed)
    for _ in range(12):
        rows = order(rows_of(rng.randint(0, 4), rng))
        seen, steps = set(), []
        for _, role, text in rows:
            body = text.strip(turns.WHITE)
            steps.append((role, text, 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit, lines = every_audit(steps)
        got = turns.repair_one(*map(list, zip(*rows))) if rows else turns.repair_one([], [], [])
        assert got[5:] == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        assert got == reference(rows)


@pytest.mark.parametrize("seed", range(8))
def test_long_conversations_against_recursion(seed):
    rng = random.Random(seed)
    rows = order(rows_of(150, rng))
    assert turns.repair_one(*map(list, zip(*rows))) == reference(rows)


def test_pieces_give_what_whole_conversations_give(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, *r, rng.random() < 0.1) for c in [None, *range(12)] for r in rows_of(rng.choice((1, 2, 5, 40)), rng)]
    rows += [(99, *r, False) for r in rows_of(300, rng)]  # more than a third of all rows
    rows += [(77, None, None, None, False), (78, None, "user", None, False), (79, 4, None, "So.", False), (80, 1, "user", "x.", True), (80, 2, "user", "y.", True)]
    held(spark, rows, 5, tmp_path, piece_rows=7)


def test_large_pieces_and_long_texts(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c, *r, False) for c in range(30) for r in rows_of(rng.randint(1, 9), rng)] + [(30, 0, "user", "long " * 100_000 + ".", False), (30, 1, "assistant", "long " * 100_000 + ".", False), (30, 2, "user", "Short.", False)]
    held(spark, rows, 3, tmp_path, piece_bytes=100_000)


def test_equal_rows_of_one_conversation(spark, tmp_path):
    held(spark, [(1, 0, "user", "Same.", False)] * 500 + [(2, None, "user", "Same.", False)] * 20, 4, tmp_path, piece_rows=50)


def test_an_empty_table(spark, tmp_path):
    held(spark, [], 1, tmp_path)


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(40) for t in (0, 1)] + [(None, 3, None, None), (5, None, "user", "x")]
    got = [tuple(r) for r in turns.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    want = []
    for c, t, role, text in rows:
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else text.translate({ord(x): None for x in ".!?"}) if hit == 2 else text
        want += [(c, t, "user" if hit == 4 else role, text, hit == 0)] * (2 if hit == 3 else 1)
    assert sorted(map(str, got)) == sorted(map(str, want))
