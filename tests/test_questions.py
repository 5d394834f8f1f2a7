"""Questions in words: every kind has a query that runs and gives what the table functions give."""

import pytest
from pyspark.sql import functions as F

from trackloom.functions import text as T
from trackloom.operators import graph, messages as M, motion, reid
from trackloom.plans import language, traversals as Q
from trackloom.sources.adapter import CONFIG, tracks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    s = motion.enrich(tracks(spark, SF), CONFIG)
    tables = graph.build(s, CONFIG)
    parts = s.select("sequence_id", F.expr("track_id * 10 + frame_id div 20").alias("track_id"), "frame_id", "class_name", "heading_deg", "cx", "cy")
    accepted = reid.resolve(reid.snapshots(parts), CONFIG)["same_entity_as"]
    talk = spark.createDataFrame([("1", "seq_0", "bob", "a car", 1), ("2", "seq_1", "eve", "x", 2)], "message_id string, sequence_id string, sender string, text string, timestamp long")
    views = dict(tables) | {"edge_same_entity_as": accepted, "node_message": M.normalise(talk), "stationary_runs": motion.stationary_runs(s, 0)}
    language.register_views(views)
    return views


QUESTIONS = {
    "Show the trajectory of track 7": lambda g: Q.trajectory(g, "seq_0", 7).count(),
    "Which events involve track 2?": lambda g: Q.events_of(g, "seq_0", 2).count(),
    "How crowded is it in frame 10?": lambda g: Q.zone_density(g, 10, "seq_0").count(),
    "Which objects went from cell_1_0 to cell_1_1?": lambda g: Q.moved_between(g, "cell_1_0", "cell_1_1", "seq_0").count(),
    "How many people are there in each zone?": lambda g: Q.in_sequence(Q.persons_by_zone(g), "seq_0").count(),
    "Any near misses in clear weather?": lambda g: Q.near_misses_in(g, weather="clear").count(),
    "Any near misses?": lambda g: Q.in_sequence(g["edge_near_miss"], "seq_0").count(),
    "Which pedestrians are near vehicles?": lambda g: Q.group_proximity(g, sequence_id="seq_0").count(),
    "Are there convoys?": lambda g: Q.in_sequence(g["edge_convoy_with"], "seq_0").count() // 2,
    "Did a crowd lead to loitering?": lambda g: Q.crowd_then_loiter(g, "seq_0").count(),
    "Where are the loitering hot spots?": lambda g: g["edge_loitering_in"].select("zone_id").distinct().count(),
    "Is anybody loitering?": lambda g: Q.in_sequence(g["edge_loitering_in"], "seq_0").select("zone_id").distinct().count(),
    "Which vehicles are stationary for more than 10 frames?": lambda g: g["stationary_runs"].where("class_name in ('car', 'truck') and n_frames > 10 and sequence_id = 'seq_0'").count(),
    "Messages from bob": lambda g: 1, "Which messages were sent?": lambda g: 1, "Lifespan of track 20": lambda g: None, "Audit the graph: how many nodes?": lambda g: None,
    "How many objects of each class?": lambda g: Q.class_counts(g, "seq_0").count(), "Which classes are there?": lambda g: Q.in_sequence(g["node_object"], "seq_0").select("class").distinct().count(),
    "What happened?": lambda g: Q.in_sequence(g["node_event"], "seq_0").select("event_type").distinct().count(), "Show me the tracks": lambda g: Q.in_sequence(g["node_object"], "seq_0").count(),
}


def test_every_kind_of_question(spark, g):
    for question, want in QUESTIONS.items():
        r = language.ask(spark, question, "seq_0", limit=100_000)
        assert r.error is None and r.attempts == 1, (question, r.error)
        n = want(g)
        assert n is None or r.rows.count() == n, question


def test_summaries_tables_and_failures(spark, g):
    assert language.rows_of(spark, "SELECT class FROM node_object WHERE track_id = :t AND sequence_id = :s", t=1, s="seq_0") == [{"class": "car"}]
    with pytest.raises(ValueError):
        language.rows_of(spark, "DROP VIEW node_object")
    r = language.ask(spark, "Which classes are there?", "seq_0")
    assert language.result_summary(r) == {"answer": r.answer, "sql": r.sql, "result_count": r.rows.count(), "has_error": False, "error": None}
    assert language.result_table([{1: "a", "b": None}]) == [{"1": "a", "b": None}]
    assert language.safely("  ", lambda q: 1 / 0).error == "empty question"
    failed = language.safely(" x ", lambda q: 1 / 0)
    assert failed.error == "division by zero" and failed.rows is None and language.result_summary(failed)["has_error"]


def test_class_questions_fall_back_to_the_objects(spark, g):
    class Edges:
        def __init__(self, sql):
            self.sql = sql

        def generate(self, system, prompt):
            return self.sql

    g["edge_belongs_to_class"].where("false").createOrReplaceTempView("edge_belongs_to_class")
    try:
        inventory = language.ask(spark, "which types are there", "seq_0", Edges("SELECT DISTINCT name FROM edge_belongs_to_class WHERE sequence_id = :seq"))
        counts = language.ask(spark, "how many of each class", "seq_0", Edges("SELECT name, count(*) FROM edge_belongs_to_class WHERE sequence_id = :seq GROUP BY name"))
        other = language.ask(spark, "how fast are they", "seq_0", Edges("SELECT name FROM edge_belongs_to_class WHERE sequence_id = :seq"))
    finally:
        g["edge_belongs_to_class"].createOrReplaceTempView("edge_belongs_to_class")
    assert inventory.rows.columns == ["object_class"] and inventory.rows.count() > 1
    assert counts.rows.columns == ["object_class", "object_count"] and other.answer == language.NO_DATA


def test_query_rules_as_function_and_column(spark):
    texts = ["", "```cypher\nMATCH (o) RETURN o\n```", "MATCH (o) WHERE o.IS_ACTIVE RETURN o", "MATCH (o) WHERE o.was_is_active RETURN o", "MATCH (o) RETURN o HAVING 1", "```\nMERGE (o) RETURN o```", "MATCH ([o)] RETURN o", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.query_problem(F.col("t")).alias("p")).orderBy("i").collect()
    assert [r.p for r in rows[:-1]] == [T.validate_query(t)[1] for t in texts[:-1]] == ["empty", None, "not_stored", None, "sql_only", "write", "unbalanced"]


def test_aliases_grow_lists_in_place():
    q = "MATCH (o) WHERE o.class IN [ \"Person\" , 'dog'] OR o.class in ['car'] RETURN o"
    assert T.expand_aliases("how many people", q) == "MATCH (o) WHERE o.class IN [ \"Person\" , 'dog', 'pedestrian', 'people'] OR o.class in ['car'] RETURN o"
    assert T.expand_aliases("how many trucks", q) == q and T.expand_aliases("people", "class IN ['person") == "class IN ['person"
    assert T.taxonomy_fallback("which types", "MATCH ()-[:BELONGS_TO_CLASS]->(c) RETURN COUNT(c)") == "counts" and T.taxonomy_fallback("how fast", "BELONGS_TO_CLASS") is None


def test_only_queries_pass(spark):
    for query in ("SELECT 1", "WITH x AS (SELECT 1 AS a) SELECT a FROM x", "SELECT 1 UNION SELECT 2", "VALUES (1), (2)"):
        assert T.validate_sql(spark, query) == (True, None), query
    for query in ("DROP VIEW v", "DROP TABLE t", "CREATE TABLE t AS SELECT 1", "INSERT INTO t SELECT 1", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "SET a = 1", "CACHE TABLE t", "DELETE FROM t", "CREATE VIEW v AS SELECT 1", "USE x"):
        assert not T.validate_sql(spark, query)[0], query
    assert not T.validate_sql(spark, "SELECT (1")[0]


def test_failed_and_empty_questions_are_logged(spark, g, tmp_path):
    class Says:
        def __init__(self, *queries):
            self.queries = list(queries)

        def generate(self, system, prompt):
            return self.queries.pop(0)

    log = str(tmp_path / "log")
    fine = language.ask(spark, "fine", "seq_0", Says("SELECT track_id FROM node_object WHERE sequence_id = :seq"), log=log)
    assert fine.error is None and not (tmp_path / "log").exists()
    mended = language.ask(spark, "mended", "seq_0", Says("DROP TABLE node_object", "SELECT no_such FROM node_object", "SELECT track_id FROM node_object"), log=log)
    assert mended.error is None and mended.attempts == 3
    none = language.ask(spark, "none", "seq_9", Says("SELECT track_id FROM node_object WHERE sequence_id = :seq"), log=log)
    assert none.answer == language.NO_DATA
    rows = sorted((r.question, r.sequence_id, r.attempt, r.kind, r.query is not None, r.error is not None) for r in spark.read.json(log).collect())
    assert rows == [("mended", "seq_0", 1, "validator", True, True), ("mended", "seq_0", 2, "execution", True, True), ("none", "seq_9", 1, "empty", True, False)]
