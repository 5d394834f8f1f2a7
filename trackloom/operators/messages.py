"""Messages: normalisation, mentioned classes, links to objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import CLASS_GROUPS

KNOWN = tuple(sorted((n for names in CLASS_GROUPS.values() for n in names), key=lambda n: (-len(n), n)))


def normalise(messages: DataFrame, arrival: str | None = None) -> DataFrame:
    """(message_id, sequence_id, sender, text, timestamp): defaults filled, the last row of an id wins.

    ``arrival`` names the column that orders the rows as they came, as a graph store would see
    them.  A table has no order of its own, so without it the last is that of the largest
    timestamp, then text.
    """
    m = messages.select(
        "message_id", "sequence_id", F.coalesce("sender", F.lit("Unknown")).alias("sender"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("timestamp", F.lit(0)).cast("long").alias("timestamp"),
        (F.col(arrival) if arrival else F.lit(0)).alias("arrival"),
    )
    last = m.groupBy("message_id").agg(F.max_by(F.struct("sequence_id", "sender", "text", "timestamp"), F.struct("arrival", "timestamp", "text")).alias("s"))
    return last.select("message_id", "s.*")


def entities(messages: DataFrame, vocabulary: tuple[str, ...] = KNOWN) -> DataFrame:
    """(message_id, sequence_id, entity): words of a vocabulary that occur in the text as whole words, lower-cased."""
    pattern = r"\b(" + "|".join(vocabulary) + r")\b"
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1))
    return messages.select("message_id", "sequence_id", F.explode(found).alias("entity"))


def mentions(found: DataFrame, objects: DataFrame) -> DataFrame:
    """(sequence_id, message_id, track_id): objects of a mentioned class in the message's sequence."""
    o = objects.select("sequence_id", "track_id", F.lower("class").alias("entity"))
    return found.join(o, ["sequence_id", "entity"]).select("sequence_id", "message_id", "track_id").dropDuplicates()
