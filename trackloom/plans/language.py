"""Questions in words to parametrised SQL, rows and answers.

The client that writes queries is injectable; the default is a rule-based matcher, so
nothing here needs a network.  Only result rows that a reader sees reach the driver.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession, types as T

from ..functions.text import CLASS_WORDS, about, validate_sql
from ..sources.sinks import audit
from . import digest

LIMIT, ATTEMPTS, SHOWN, MEMORY_ROWS, MAX_STEPS = 50, 3, 10, 5, 12
INVENTORY = "SELECT DISTINCT class AS object_class FROM node_object WHERE sequence_id = :seq ORDER BY object_class"
COUNTS = "SELECT class AS object_class, count(*) AS object_count FROM node_object WHERE sequence_id = :seq GROUP BY class ORDER BY object_count DESC, object_class"
NO_DATA = "No matching data was found for this question."
FAILED = "The question could not be turned into a valid query."


class Client(Protocol):
    def generate(self, system: str, prompt: str) -> str: ...


#: (pattern of a question, SQL over the registered views): the first pattern that is found decides.  ``:seq`` is the sequence; names in
#: braces come from the pattern's groups, which hold nothing but digits, zone names and single words.
_TRACK, _FRAME, _ZONE = r"(?:track|object|id)\s*#?(?P<track>\d+)", r"frame\s*#?(?P<frame>\d+)", r"cell_\d+_\d+"
_VEHICLES = "('car', 'van', 'truck', 'bus')"
INTENTS: tuple[tuple[str, str], ...] = (
    # trajectory, identity, events of one track
    (rf"(trajectory|path|route|where did).*{_TRACK}", "SELECT frame_id, cx, cy FROM edge_appeared_in WHERE sequence_id = :seq AND track_id = {track} ORDER BY frame_id"),
    (rf"(lifespan|life|same (entity|object)|re-?identif).*{_TRACK}", """WITH link AS (SELECT track_a AS a, track_b AS b FROM edge_same_entity_as WHERE sequence_id = :seq UNION SELECT track_b, track_a FROM edge_same_entity_as WHERE sequence_id = :seq),
      one AS (SELECT {track} AS t UNION SELECT b FROM link WHERE a = {track}), two AS (SELECT t FROM one UNION SELECT b FROM link JOIN one ON a = t), three AS (SELECT t FROM two UNION SELECT b FROM link JOIN two ON a = t)
      SELECT track_id, frame_id, cx, cy FROM edge_appeared_in LEFT SEMI JOIN three ON track_id = t WHERE sequence_id = :seq ORDER BY frame_id, track_id"""),
    (rf"events?.*{_TRACK}|what (happened|did).*{_TRACK.replace('track>', 'other>')}", """SELECT e.event_type, e.frame_id, i.role, e.metadata_json FROM edge_involves i JOIN node_event e ON i.event_key = e.event_key AND i.sequence_id = e.sequence_id
      WHERE i.sequence_id = :seq AND i.track_id = {track} ORDER BY e.frame_id"""),
    # places
    (rf"(density|crowded|how full).*{_FRAME}", "SELECT zone_id, count(*) AS density FROM edge_in_zone WHERE sequence_id = :seq AND frame_id = {frame} GROUP BY zone_id ORDER BY density DESC, zone_id"),
    (rf"from (zone )?(?P<zone_a>{_ZONE}) to (zone )?(?P<zone_b>{_ZONE})", """SELECT a.track_id, a.entry AS left_from, b.entry AS arrived_at FROM (SELECT track_id, min(frame_id) AS entry FROM edge_in_zone WHERE sequence_id = :seq AND zone_id = '{zone_a}' GROUP BY track_id) a
      JOIN (SELECT track_id, min(frame_id) AS entry FROM edge_in_zone WHERE sequence_id = :seq AND zone_id = '{zone_b}' GROUP BY track_id) b ON a.track_id = b.track_id WHERE a.entry < b.entry ORDER BY a.track_id"""),
    (r"(people|persons?|pedestrians?).*(each|per|by) zone", """SELECT zone_id, count(*) AS person_count, count(DISTINCT z.track_id) AS distinct_persons FROM edge_in_zone z JOIN node_object o ON z.track_id = o.track_id AND z.sequence_id = o.sequence_id
      WHERE z.sequence_id = :seq AND o.class IN ('person', 'pedestrian', 'people') GROUP BY zone_id ORDER BY person_count DESC, zone_id"""),
    # events of two objects, or of one in a zone
    (r"near.?miss(es)?.*(?P<weather>clear|foggy|rainy|overcast)", """SELECT a_track_id, b_track_id, frame_id, distance, CASE WHEN distance < 0.03 THEN 'critical' ELSE 'warning' END AS severity FROM edge_near_miss
      WHERE sequence_id IN (SELECT sequence_id FROM node_scene WHERE weather = '{weather}') ORDER BY severity, frame_id"""),
    (r"near.?miss", "SELECT a_track_id, b_track_id, frame_id, distance FROM edge_near_miss WHERE sequence_id = :seq ORDER BY frame_id"),
    (r"(people|persons?|pedestrians?|vulnerable).*(near|close to).*(vehicles?|cars?)|(vehicles?|cars?).*(near|close to).*(people|persons?|pedestrians?)", """SELECT x.track_id AS person, y.track_id AS vehicle, n.frame_id, n.distance FROM edge_near n
      JOIN edge_belongs_to_class x ON x.sequence_id = n.sequence_id AND x.track_id IN (n.a_track_id, n.b_track_id) AND x.class_group = 'VulnerableRoadUser'
      JOIN edge_belongs_to_class y ON y.sequence_id = n.sequence_id AND y.track_id IN (n.a_track_id, n.b_track_id) AND y.class_group = 'MotorVehicle' WHERE n.sequence_id = :seq ORDER BY n.distance, person, vehicle"""),
    (r"convoys?", "SELECT a_track_id, b_track_id, avg_distance FROM edge_convoy_with WHERE sequence_id = :seq AND a_track_id < b_track_id"),
    (r"crowds?.*(loiter|before|caus|trigger|lead)", """SELECT l.frame_id AS loiter_frame, max(c.frame_id) AS crowd_frame FROM node_event l JOIN node_event c ON c.sequence_id = l.sequence_id AND c.frame_id BETWEEN l.frame_id - 30 AND l.frame_id - 1
      WHERE l.sequence_id = :seq AND l.event_type = 'LOITER' AND c.event_type = 'CROWD_FORM' GROUP BY l.frame_id ORDER BY l.frame_id"""),
    (r"(all|every|any) sequences?.*loiter|loiter\w*.*(hot ?spots?|all sequences)", "SELECT zone_id, count(*) AS loiter_events FROM edge_loitering_in GROUP BY zone_id ORDER BY loiter_events DESC, zone_id LIMIT 10"),
    (r"loiter", "SELECT zone_id, count(*) AS loiter_events FROM edge_loitering_in WHERE sequence_id = :seq GROUP BY zone_id ORDER BY loiter_events DESC, zone_id"),
    (r"jaywalk", "SELECT track_id, zone_id, frame_id FROM edge_jaywalking_in WHERE sequence_id = :seq ORDER BY frame_id, track_id"),
    (r"(stationary|parked|stopped|standing).*?(?P<n>\d+)|(?P<m>\d+) frames.*(stationary|parked|stopped|standing)", f"""SELECT track_id, class_name, start_frame, end_frame, n_frames FROM stationary_runs WHERE sequence_id = :seq AND class_name IN {_VEHICLES} AND n_frames > {{n}} ORDER BY n_frames DESC, track_id"""),
    # messages
    (r"messages?.*(from|by|of) (?P<sender>\w+)", "SELECT message_id, text FROM node_message WHERE sender = '{sender}'"),
    (r"messages?", "SELECT message_id, sender, text FROM node_message WHERE sequence_id = :seq"),
    # inventories
    (r"audit|how many (nodes|edges|relationships)", "SELECT event_type AS name, count(*) AS n FROM node_event GROUP BY event_type UNION ALL SELECT class, count(*) FROM node_object GROUP BY class ORDER BY name"),
    (r"how many.*(class|type|categor)|class counts|(each|per|by) (class|type|category)", "SELECT class, count(*) AS n FROM node_object WHERE sequence_id = :seq GROUP BY class ORDER BY n DESC, class"),
    (r"(which|what|list).*(class|type|categor)|types of objects", "SELECT DISTINCT class FROM node_object WHERE sequence_id = :seq ORDER BY class"),
    (r"density|crowded|zones?", "SELECT zone_id, count(*) AS density FROM edge_in_zone WHERE sequence_id = :seq GROUP BY zone_id ORDER BY density DESC, zone_id"),
    (r"events?|happened", "SELECT event_type, count(*) AS n FROM node_event WHERE sequence_id = :seq GROUP BY event_type ORDER BY n DESC, event_type"),
    (r"", "SELECT track_id, class FROM node_object WHERE sequence_id = :seq ORDER BY track_id"),
)


class RuleClient:
    """Picks the first intent whose pattern is found in the question and fills in what it names."""

    def generate(self, system: str, prompt: str) -> str:
        question = prompt.lower()
        pattern, sql = next((p, q) for p, q in INTENTS if re.search(p, question))
        named = {k: v for k, v in re.search(pattern, question).groupdict().items() if v is not None}
        for other, name in (("other", "track"), ("m", "n")):
            if other in named:
                named[name] = named.pop(other)
        return sql.format(**named)


@dataclass
class QueryResult:
    question: str
    sql: str
    rows: DataFrame | None
    answer: str
    error: str | None = None
    attempts: int = 0


def register_views(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def rows_of(spark: SparkSession, query: str, **params) -> list[dict]:
    """The rows of a read-only query with named parameters, as dictionaries; anything but a query raises ValueError."""
    ok, why = validate_sql(spark, query)
    if not ok:
        raise ValueError(why)
    return [r.asDict() for r in spark.sql(query, args=params).limit(LIMIT).collect()]


def result_table(rows: list[dict]) -> list[dict]:
    """Rows for a table widget: the same values under column names that are texts."""
    return [{str(k): v for k, v in r.items()} for r in rows]


def result_summary(result: QueryResult) -> dict:
    """What a reader sees of a result besides its rows."""
    n = 0 if result.rows is None else result.rows.count()
    return {"answer": result.answer, "sql": result.sql or None, "result_count": n, "has_error": bool(result.error), "error": result.error}


def safely(question: str, run: Callable[[str], QueryResult]) -> QueryResult:
    """Run a question for a user interface: blank ones are turned away, a failure becomes a result that says so."""
    if not question.strip():
        return QueryResult("", "", None, "Please ask a question.", "empty question")
    try:
        return run(question.strip())
    except Exception as e:
        return QueryResult(question.strip(), "", None, "The query failed before there were results.", str(e).splitlines()[0] if str(e) else type(e).__name__)


def answer_rows(rows: list[dict], more: bool) -> str:
    """No rows give a fixed answer and no client is asked."""
    if not rows:
        return NO_DATA
    return f"{len(rows)}{'+' if more else ''} rows: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.items()) for r in rows)


def ask(spark: SparkSession, question: str, sequence_id: str, client: Client | None = None, limit: int = LIMIT, log: str | None = None) -> QueryResult:
    """Generate, validate, run; an error is fed back, at most ``ATTEMPTS`` times.

    ``log``: a folder to which failed attempts and queries without rows are appended (kind: validator, execution or empty).
    """
    notes: list[tuple] = []
    try:
        return _ask(spark, question, sequence_id, client, limit, notes)
    finally:
        if log is not None and notes:
            rows = [(question, sequence_id, *n) for n in notes]
            audit(spark.createDataFrame(rows, "question string, sequence_id string, kind string, attempt int, query string, error string"), log)


def _ask(spark: SparkSession, question: str, sequence_id: str, client: Client | None, limit: int, notes: list[tuple]) -> QueryResult:
    if not question.strip():
        return QueryResult(question, "", None, "Please ask a question.", "empty question")
    client, prompt, sql, error = client or RuleClient(), question, "", None
    for k in range(1, ATTEMPTS + 1):
        sql = re.sub(r"^```\w*\s*|\s*```$", "", client.generate("Answer with one Spark SQL query.", prompt).strip())
        ok, error = validate_sql(spark, sql)
        if ok:
            try:
                rows = spark.sql(sql, args={"seq": sequence_id}).limit(limit)
                shown = [r.asDict() for r in rows.take(SHOWN + 1)]
                if not shown and "edge_belongs_to_class" in sql and about(question, CLASS_WORDS, literal=True):
                    sql = COUNTS if "count(" in sql.lower() else INVENTORY  # no class edges: ask the objects themselves
                    rows = spark.sql(sql, args={"seq": sequence_id}).limit(limit)
                    shown = [r.asDict() for r in rows.take(SHOWN + 1)]
                if not shown:
                    notes.append(("empty", k, sql, None))
                return QueryResult(question, sql, rows, answer_rows(shown[:SHOWN], len(shown) > SHOWN), None, k)
            except Exception as e:  # what Spark says goes back to the client
                error = str(e).splitlines()[0]
                notes.append(("execution", k, sql, error))
        else:
            notes.append(("validator", k, sql, error))
        prompt = f"{question}\nThe last query failed: {error}"
    return QueryResult(question, sql, None, FAILED, error, ATTEMPTS)


def parse_decision(text: str) -> dict:
    """A step as JSON, fenced or embedded; an unknown action becomes INFER, unreadable text the final answer."""
    text = re.sub(r"^```\w*\s*|\s*```$", "", text.strip())
    for candidate in (text, *(re.findall(r"\{[^{}]*\}", text)[:1])):
        try:
            d = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(d, dict) and "action" in d:
            action = str(d["action"]).upper()
            return {"thought": d.get("thought", ""), "action": action if action in ("QUERY", "INFER", "FINAL_ANSWER") else "INFER", "action_input": d.get("action_input", "")}
    return {"thought": "", "action": "FINAL_ANSWER", "action_input": text}


@dataclass
class Reasoner:
    """Query and infer in steps until a final answer; non-empty queries are followed by a digest of their rows."""

    decide: Callable[[str, list[dict]], str]
    spark: SparkSession
    sequence_id: str
    client: Client | None = None
    memory: list[dict] = field(default_factory=list)

    def run(self, question: str) -> Iterator[dict]:
        for _ in range(MAX_STEPS):
            step = parse_decision(self.decide(question, self.memory))
            if step["action"] == "QUERY":
                r = ask(self.spark, step["action_input"] or question, self.sequence_id, self.client)
                step |= {"sql": r.sql, "results": [x.asDict() for x in r.rows.take(MEMORY_ROWS)] if r.rows is not None else [], "error": r.error}
            self.memory.append(step)
            yield step
            if step["action"] == "FINAL_ANSWER":
                return
            if step.get("results"):
                self.memory.append({"thought": "", "action": "SUMMARIZE", "action_input": digest.summary(r.rows)})
                yield self.memory[-1]
        yield {"thought": "", "action": "FINAL_ANSWER", "action_input": "No answer within the step limit."}


def visual_targets(rows: list[dict]) -> dict[str, list]:
    """Frames, tracks (not negative) and sequences named in result rows, by column name."""
    out: dict[str, list] = {"frames": [], "tracks": [], "sequences": []}
    for r in rows:
        for k, v in r.items():
            name = k.lower()
            if "sequence_id" in name and v is not None:
                out["sequences"].append(str(v))
            elif isinstance(v, int) and not isinstance(v, bool):
                if "frame" in name:
                    out["frames"].append(v)
                elif "track" in name and v >= 0:
                    out["tracks"].append(v)
    return {k: sorted(set(v)) for k, v in out.items()}


def chart_spec(df: DataFrame) -> dict | None:
    """First text or integer column as label, first other numeric one as value."""
    label = next((f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.IntegralType))), None)
    value = next((f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label), None)
    return {"x": label, "y": value} if label and value else None
