"""Conversation structure repair by Dial's shortest paths.

A conversation's rows, in order, are steps through a small automaton (0 nothing yet, 1 after
the system turn, 2 after a user turn, 3 after an assistant turn); it may end in 0 or 3.
Edits are arcs of small whole cost between nodes (row, state), so Dial's queue of buckets
finds all distances to the end without a heap (``dial``): a ring of buckets as long as the
dearest arc.  The audit walks tight arcs (distance = cost + distance of the next node) from
the start and takes the ASCII-least letter each time; a letter names one arc, so this gives
the least of all cheapest audits (``walk``).

At scale.  Rows are sorted by conversation and turn over range partitions that may cut a
conversation anywhere, then read as a stream.  Conversations that lie inside a partition and
within ``PIECE_ROWS`` and ``PIECE_BYTES`` are repaired on the way.  All others become pieces
of at most that size:
* copies are told by the smallest place of equal rows (counted, then joined);
* a piece's costs between all states form a 4 x 4 matrix; matrices, not rows, are folded
  backwards over a conversation, which gives each piece its distances to the end, and the
  states chosen are folded forwards;
* then every piece is walked by itself, and its repaired text is hashed in order, a batch of
  pieces in memory at a time (one hash over a whole text can't be split any further).
So a conversation may hold any share of the rows: its rows are repaired by many tasks, and one
task sees 16 numbers for every ``PIECE_ROWS`` rows, and the stream to be hashed.

Nulls: a null role or text is one space; null turns come first; a null conversation is one
of its own.  Ties in turn go by role, then text, in code point order.  Empty texts are blank.
Repeated rows are duplicates.  Conversations whose rows are all gone give zeros, an empty
audit and the empty string's hash; an empty table gives no rows; further columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_sql, cut, ensure_checkpoint_dir, join_one

PIECE_ROWS, PIECE_BYTES = 4096, 8 << 20
WHITE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: Letters of roles, then their state changes; o is any other role.
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
STATES = range(4)
INSERTED = {0: 2, 1: 2, 2: 3, 3: 2}
SPOKEN = {2: "user", 3: "assistant"}
ENDS = (0, FAR, FAR, 0)
#: A step is a role's letter, upper-case if truncated, or - if it must go.
STEPS = "suaoSUAO-"


def arcs(step: str) -> dict[int, list[tuple[str, int, int]]]:
    """State before the row -> (letter, cost, state after it), by letter."""
    out = {q: [("D", DELETE, q)] for q in STATES}
    if step != "-":
        more = TRUNCATED * step.isupper()
        for q in STATES:
            if q in NEXT[step.lower()]:
                out[q].append(("K", KEEP + more, NEXT[step.lower()][q]))
            out[q].append(("R", REROLE + more, INSERTED[q]))
    return out


ARCS = {s: arcs(s) for s in STEPS}
#: State after the row -> (state before it, cost).
BACK = {s: [[(p, c) for p in STATES for _, c, t in ARCS[s][p] if t == q] for q in STATES] for s in STEPS}
BACK_INSERT = [[p for p in STATES if INSERTED[p] == q] for q in STATES]
DEAREST = max(c for table in ARCS.values() for found in table.values() for _, c, _ in found)


def dial(steps: str, ends: tuple[int, ...] = ENDS, start: int | None = None) -> list[int]:
    """Distance to the end from each node 4 * row + state, ``ends`` being what is left to pay behind the last row.

    With ``start``, a state, the search stops once that state before the first row is settled with all nodes as near.
    """
    n = len(steps)
    dist = [FAR] * (4 * n + 4)
    least = min(ends)
    if least >= FAR:
        return dist
    size = 1 + max(DEAREST, INSERT, max(e - least for e in ends if e < FAR))
    ring: list[list[int]] = [[] for _ in range(size)]
    waiting = 0
    for q in STATES:
        if ends[q] < FAR:
            dist[4 * n + q] = ends[q]
            ring[ends[q] % size].append(4 * n + q)
            waiting += 1
    d = least
    while waiting:
        bucket = ring[d % size]
        while bucket:  # arcs of cost 0 add to it
            v = bucket.pop()
            waiting -= 1
            if dist[v] != d:
                continue
            i, q = v >> 2, v & 3
            for p in BACK_INSERT[q]:
                w = 4 * i + p
                if d + INSERT < dist[w]:
                    dist[w] = d + INSERT
                    ring[(d + INSERT) % size].append(w)
                    waiting += 1
            if i:
                for p, c in BACK[steps[i - 1]][q]:
                    w = 4 * i - 4 + p
                    if d + c < dist[w]:
                        dist[w] = d + c
                        ring[(d + c) % size].append(w)
                        waiting += 1
        if start is not None and dist[start] <= d:
            break
        d += 1
    return dist


def walk(steps: str, dist: list[int], ends: tuple[int, ...] = ENDS, state: int = 0) -> tuple[str, int]:
    """(least audit among the cheapest, last state)."""
    n, i, q, audit = len(steps), 0, state, []
    while True:
        left = dist[4 * i + q]
        if i == n and left == ends[q]:
            return "".join(audit), q
        to = INSERTED[q]
        options = [("I", INSERT, i, to)] if i == n else [(x, c, i + 1, t) for x, c, t in ARCS[steps[i]][q]] + [("I", INSERT, i, to)]
        letter, _, i, q = min(o for o in options if left == o[1] + dist[4 * o[2] + o[3]])
        audit.append(letter)


def repaired(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The lines ``role:text`` that an audit leaves of the rows."""
    out, i = [], 0
    for x in audit:
        if x == "D":
            i += 1
            continue
        role = roles[i] if x == "K" else SPOKEN[INSERTED[state]]
        state = NEXT[role[0]][state]
        out.append(f"{role}:" if x == "I" else f"{role}:{texts[i]}")
        i += x != "I"
    return out


def step_of(role: str, text: str, seen: bool) -> tuple[str, int]:
    """(step, first fault: 0 none, 1 blank, 2 duplicate, 3 truncated)."""
    end = text.rstrip(WHITE)[-1:]
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    if not end or seen:
        return "-", 2 if end else 1
    return (kind, 0) if end in ".!?" else (kind.upper(), 3)


def is_legal(a: str, b: str) -> bool:
    return a[:1] + b[:1] in ("su", "ua", "au")


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split()[0] for x in RESULT.split(", ")]


def repair_one(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """RESULT of a whole conversation."""
    seen, steps, faults = set(), [], [0] * 4
    for row in zip(roles, texts):
        step, fault = step_of(*row, row in seen)
        seen.add(row)
        steps.append(step)
        faults[fault] += 1
    steps = "".join(steps)
    dist = dial(steps, start=0)
    audit, _ = walk(steps, dist)
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(not is_legal(a, b) for a, b in itertools.pairwise(roles))
    return gaps, *faults[1:], illegal, dist[0], audit, hashlib.sha256("\n".join(repaired(audit, 0, roles, texts)).encode()).hexdigest()


def damage(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with made-up damage, a sixth of them or so, drawn by conversation and turn."""
    r, t = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    out = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("hit"))
    hit = F.col("hit")
    body = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    who = F.when(hit == 4, F.lit("user")).otherwise(F.col("role"))
    out = out.select("conv_id", "turn", who.alias("role"), body.alias("text"), (hit == 0).alias("gone"), F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation, turn, role and text; equal places in that order up to a prefix of role and text stay in one task."""
    short = F.when(F.length("role") <= 16, F.substring("text", 1, 32))
    ranges = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 16).asc(), short.asc_nulls_last()]
    exact = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return rows.repartitionByRange(*ranges).sortWithinPartitions(*exact)


def _sorted_stream(number: int, batches: Iterator[pa.RecordBatch], piece_rows: int, piece_bytes: int) -> Iterator[tuple]:
    """Rows of a result for each conversation that surely lies inside this partition; pieces of the others."""
    places, result = itertools.count(number << 33), (None,) * len(NAMES)
    conv, held, size, inside, started = None, ([], [], []), 0, False, False
    for b in batches:
        for name, turn, role, text, gone in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))):
            if not started or name != conv:
                if started:
                    yield (conv, None, *repair_one(*held), None, None, None) if inside else (conv, next(places), *result, *held)
                inside = started  # the first one may have begun in the partition before
                conv, held, size, started = name, ([], [], []), 0, True
            if gone:
                continue
            if len(held[0]) >= piece_rows or size >= piece_bytes:
                yield conv, next(places), *result, *held
                held, size, inside = ([], [], []), 0, False
            held[0].append(turn), held[1].append(role), held[2].append(text)
            size += len(role) + len(text)
    if started:  # it may go on in the partition behind
        yield conv, next(places), *result, *held


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 512, most_chars: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(sum(map(len, x)) if isinstance(x, list) and x and isinstance(x[0], str) else len(x) if isinstance(x, (str, bytes)) else 8 for x in r)
        if len(held) >= most or size >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _map(rows: DataFrame, function, ddl: str) -> DataFrame:
    """``function(partition, batches) -> tuples`` over Arrow batches."""
    schema = T.StructType.fromDDL(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return _batches(function(TaskContext.get().partitionId(), batches), arrow)

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def _steps(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """What is known of a piece by itself."""
    for b in batches:
        for conv, piece, turns, roles, texts, again in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "turns", "roles", "texts", "again"))):
            again = set(again or ())
            found = [step_of(r, t, k in again) for k, (r, t) in enumerate(zip(roles, texts))]
            steps = "".join(x for x, _ in found)
            faults = [sum(f == k for _, f in found) for k in (1, 2, 3)]
            costs = [dial(steps, tuple(0 if q == end else FAR for q in STATES))[:4] for end in STATES]
            known = [t for t in turns if t is not None]
            span = (known[0], known[-1], len(set(known))) if known else (None, None, 0)
            edges = (roles[0], roles[-1]) if roles else (None, None)
            yield conv, piece, steps, [costs[end][q] for q in STATES for end in STATES], *span, *edges, *faults, sum(not is_legal(x, y) for x, y in itertools.pairwise(roles)), roles, texts


def _needs(found: pd.DataFrame) -> pd.DataFrame:
    """Each piece's distances to the end of the conversation from the states behind it."""
    found = found.sort_values("piece", ascending=False)
    ends, out = ENDS, []
    for matrix in found["matrix"]:
        out.append(list(ends))
        ends = tuple(min(FAR, min(int(matrix[4 * q + end]) + ends[end] for end in STATES)) for q in STATES)
    return pd.DataFrame({"piece": found["piece"], "ends": out})


def _exits(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The state behind a piece for each state before it (-1: no way to the end)."""
    for b in batches:
        for conv, piece, steps, ends in zip(*(b.column(c).to_pylist() for c in ("conv_id", "piece", "steps", "ends"))):
            dist = dial(steps, tuple(ends))
            yield conv, piece, ends, [walk(steps, dist, tuple(ends), q)[1] if dist[q] < FAR else -1 for q in STATES]


def _entries(found: pd.DataFrame) -> pd.DataFrame:
    """Each piece's state before it."""
    found = found.sort_values("piece")
    state, out = 0, []
    for exits in found["exits"]:
        out.append(state)
        state = int(exits[state])
    return pd.DataFrame({"piece": found["piece"], "ends": found["ends"], "state": out})


def _walks(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Every piece's audit, cost and repaired lines."""
    for b in batches:
        columns = ("conv_id", "piece", "steps", "ends", "state", "roles", "texts")
        for conv, piece, steps, ends, state, roles, texts in zip(*(b.column(c).to_pylist() for c in columns)):
            dist = dial(steps, tuple(ends))
            audit, _ = walk(steps, dist, tuple(ends), state)
            lines = repaired(audit, state, roles, texts)
            yield conv, piece, dist[state], audit, len(lines), "\n".join(lines)


def _sums(_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """RESULT rows from pieces that come sorted by conversation and place; texts are hashed as they come."""
    started, conv = False, None
    for b in batches:
        for name, cost, audit, n, lines, lo, hi, distinct, first, last, *counts in zip(*(b.column(c).to_pylist() for c in SUMMED)):
            if not started or name != conv:
                if started:
                    yield conv, (span[1] - span[0] + 1 - span[2] if span else 0), *sums[:3], sums[3], total, "".join(audits), text.hexdigest()
                started, conv, total, audits, span, sums, before, text, empty = True, name, cost, [], None, [0] * 4, None, hashlib.sha256(), True
            audits.append(audit)
            sums = [x + y for x, y in zip(sums, counts)]
            if lo is not None:
                span = (lo, hi, distinct) if span is None else (span[0], hi, span[2] + distinct - (lo == span[1]))
            if first is not None:
                sums[3] += before is not None and not is_legal(before, first)
                before = last
            if n:
                text.update((lines if empty else "\n" + lines).encode())
                empty = False
    if started:
        yield conv, (span[1] - span[0] + 1 - span[2] if span else 0), *sums[:3], sums[3], total, "".join(audits), text.hexdigest()


SUMMED = ("conv_id", "cost", "audit", "n", "lines", "turn_min", "turn_max", "turn_count", "role_first", "role_last", "blank", "duplicate", "truncated", "illegal")


def _join_pieces(parts: DataFrame, conv: str, turn: str) -> DataFrame:
    """RESULT of the conversations that lie in pieces."""
    rows = parts.select("conv_id", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("pos", "row"))
    role, text, name = F.col("row.roles"), F.col("row.texts"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    equal = F.sha2(F.concat_ws("\x1f", F.col("conv_id").isNull().cast("string"), F.length(name).cast("string"), name, F.length(role).cast("string"), role, text), 256)
    rows = rows.select(equal.alias("equal"), F.struct("piece", "pos").alias("place"))
    firsts = cut(rows.groupBy("equal").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    again = join_one(rows, firsts, ["equal"], "n").where("place > first").groupBy("place.piece").agg(F.collect_list("place.pos").alias("again"))
    spans = f"turn_min {turn}, turn_max {turn}, turn_count long, role_first string, role_last string, blank long, duplicate long, truncated long, illegal long"
    known = cut(_map(parts.join(again, "piece", "left"), _steps, f"conv_id {conv}, piece long, steps string, matrix array<long>, {spans}, roles array<string>, texts array<string>"))
    needs = known.select("conv_id", "piece", "matrix").groupBy("conv_id").applyInPandas(_needs, "piece long, ends array<long>")
    exits = cut(_map(known.select("conv_id", "piece", "steps").join(needs, "piece"), _exits, f"conv_id {conv}, piece long, ends array<long>, exits array<int>"))
    entries = exits.groupBy("conv_id").applyInPandas(_entries, "piece long, ends array<long>, state int")
    walked = _map(known.select("conv_id", "piece", "steps", "roles", "texts").join(entries, "piece"), _walks, f"conv_id {conv}, piece long, cost long, audit string, n long, lines string")
    whole = walked.join(known.drop("conv_id", "steps", "matrix", "roles", "texts"), "piece")
    return _map(whole.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*SUMMED), _sums, f"conv_id {conv}, {RESULT}")


def repair(rows: DataFrame, *, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """A row for each conversation of ``rows`` (conv_id, turn, role, text, gone): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A row that is ``gone`` only says that its conversation exists.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    one = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = rows.select("conv_id", "turn", one("role"), one("text"), F.coalesce(F.col("gone"), F.lit(False)).alias("gone"))
    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    found = cut(_map(in_order(rows), partial(_sorted_stream, piece_rows=piece_rows, piece_bytes=piece_bytes), f"conv_id {conv}, piece long, {RESULT}, turns array<{turn}>, roles array<string>, texts array<string>"))
    whole = found.where("piece IS NULL").select("conv_id", *NAMES)
    return whole.unionByName(_join_pieces(found.where("piece IS NOT NULL").select("conv_id", "piece", "turns", "roles", "texts"), conv, turn))


def _oracle() -> str:
    best = lambda q: f"b.best[{q + 1}]"
    edit = lambda c, letter, line, then: f"{{'c': {c} + {then}.c, 'a': '{letter}' || {then}.a, 'l': {line} || {then}.l}}"
    none = f"{{'c': CAST({FAR} AS BIGINT), 'a': '', 'l': CAST([] AS VARCHAR[])}}"
    own, more = "[r.role || ':' || r.text]", f"CASE WHEN r.fault = 3 THEN {TRUNCATED} ELSE 0 END"
    base = []
    for q in STATES:
        keeps = " ".join(f"WHEN r.kind = '{k}' THEN {edit(more, 'K', own, best(t[q]))}" for k, t in NEXT.items() if q in t)
        to = INSERTED[q]
        rerole = edit(f"{REROLE} + {more}", "R", f"['{SPOKEN[to]}:' || r.text]", best(to))
        must = "r.fault IN (1, 2)"
        base.append(f"list_min([{edit(DELETE, 'D', 'CAST([] AS VARCHAR[])', best(q))}, CASE WHEN {must} THEN {none} {keeps} ELSE {none} END, CASE WHEN {must} THEN {none} ELSE {rerole} END])")
    closed = []
    for q in STATES:
        one = INSERTED[q]
        two = INSERTED[one]
        closed.append(f"list_min([x[{q + 1}], {edit(INSERT, 'I', f"['{SPOKEN[one]}:']", f'x[{one + 1}]')}, {edit(2 * INSERT, 'II', f"['{SPOKEN[one]}:', '{SPOKEN[two]}:']", f'x[{two + 1}]')}])")
    last = ", ".join("{'c': CAST(0 AS BIGINT), 'a': '', 'l': CAST([] AS VARCHAR[])}" if e == 0 else none for e in ENDS)
    return f"""
WITH RECURSIVE named AS (
  SELECT *, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS crc_key FROM conversations),
{crc32_sql("named", "crc_key")},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc32 % 20 AS hit FROM named JOIN crc USING (crc_key)),
harmed AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(k)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM harmed),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
         CASE WHEN role[1:1] IN ('s', 'u', 'a') THEN role[1:1] ELSE 'o' END AS kind,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed),
counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
         count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM judged GROUP BY conv_id),
b AS (
  SELECT conv_id, n AS i, (SELECT list_transform([x], lambda x: [{", ".join(closed)}])[1] FROM (SELECT [{last}] AS x)) AS best FROM counts
  UNION ALL
  SELECT b.conv_id, b.i - 1, list_transform([[{", ".join(base)}]], lambda x: [{", ".join(closed)}])[1]
  FROM b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i),
done AS (SELECT conv_id, best[1] AS s FROM b WHERE i = 0)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(s.c, 0) AS BIGINT) AS cost,
       coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
