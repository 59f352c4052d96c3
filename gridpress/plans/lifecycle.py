"""Current state as a fold over append-only catalog events.

``events``: entity_id, seq (unique per entity, increasing), event. No fold
gathers the events of an entity: an entity may hold any share of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridpress.operators.ordered import chunked_lag

# Event names.
PUBLISH, ARCHIVE = "publish", "archive"
START, SUCCEED, FAIL, RESTORE, REMOVE = "start", "succeed", "fail", "restore", "remove"


# --- datasets ---------------------------------------------------------------


def accepted_transitions(events: DataFrame) -> DataFrame:
    """The two events of each dataset that count: ``published_seq``, ``archived_seq``.

    A draft accepts its first publish; the archive that counts is the first
    one after it. Both are minima, so events are reduced before the shuffle.
    """
    published = (
        events.where(F.col("event") == PUBLISH).groupBy("entity_id").agg(F.min("seq").alias("published_seq"))
    )
    archived = (
        events.where(F.col("event") == ARCHIVE)
        .join(published, "entity_id")
        .where(F.col("seq") > F.col("published_seq"))
        .groupBy("entity_id")
        .agg(F.min("seq").alias("archived_seq"))
    )
    return published.join(archived, "entity_id", "left")


def dataset_states(events: DataFrame) -> DataFrame:
    """Status of every dataset that has an event."""
    entities = events.groupBy("entity_id").agg(F.count(F.lit(1)).alias("events"))
    status = (
        F.when(F.col("archived_seq").isNotNull(), F.lit("archived"))
        .when(F.col("published_seq").isNotNull(), F.lit("published"))
        .otherwise(F.lit("draft"))
    )
    return entities.join(accepted_transitions(events), "entity_id", "left").select(
        "entity_id", status.alias("status"), "published_seq", "archived_seq", "events"
    )


def illegal_transitions(events: DataFrame) -> DataFrame:
    """Events that were refused, with the status each one met."""
    joined = events.join(accepted_transitions(events), "entity_id", "left")
    accepted = F.coalesce(F.col("seq") == F.col("published_seq"), F.lit(False)) | F.coalesce(
        F.col("seq") == F.col("archived_seq"), F.lit(False)
    )
    met = (
        F.when(F.col("seq") > F.col("archived_seq"), F.lit("archived"))
        .when(F.col("seq") > F.col("published_seq"), F.lit("published"))
        .otherwise(F.lit("draft"))
    )
    return joined.where(~accepted).select("entity_id", "seq", "event", met.alias("status"))


# --- sources ----------------------------------------------------------------


def judged_source_events(events: DataFrame) -> DataFrame:
    """Source events with ``accepted``.

    A start is accepted unless an ingest is running; succeed, fail and
    restore only while one is. Whatever was accepted, a start leaves an
    ingest running and an end leaves none, so the kind of the event just
    before decides. Nothing is accepted after removal.
    """
    removed = (
        events.where(F.col("event") == REMOVE).groupBy("entity_id").agg(F.min("seq").alias("removed_seq"))
    )
    live = (
        events.join(removed, "entity_id", "left")
        .where(F.col("removed_seq").isNull() | (F.col("seq") < F.col("removed_seq")))
        .select("entity_id", "seq", "event")
    )
    judged = chunked_lag(live, ["entity_id"], "seq", "event", "_before")
    running = F.coalesce(F.col("_before") == START, F.lit(False))
    kept = judged.select(
        "entity_id", "seq", "event", F.when(F.col("event") == START, ~running).otherwise(running).alias("accepted")
    )
    after = events.join(removed, "entity_id").where(F.col("seq") >= F.col("removed_seq"))
    return kept.unionByName(
        after.select("entity_id", "seq", "event", (F.col("seq") == F.col("removed_seq")).alias("accepted"))
    )


def source_states(events: DataFrame) -> DataFrame:
    """Status of every source: the fold of its accepted events.

    A restore returns to the status before the ingest, which is that of the
    last accepted succeed or fail.
    """
    accepted = judged_source_events(events).where("accepted")
    settled = F.col("event").isin(SUCCEED, FAIL)
    folded = accepted.groupBy("entity_id").agg(
        F.max_by("event", "seq").alias("last"),
        F.max_by(F.when(settled, F.col("event")), F.when(settled, F.col("seq"))).alias("settled"),
        F.bool_or(F.col("event") == REMOVE).alias("removed"),
    )
    status = (
        F.when(F.col("removed") | F.col("last").eqNullSafe(FAIL), F.lit("error"))
        .when(F.col("last") == START, F.lit("processing"))
        .when(F.col("settled") == SUCCEED, F.lit("ready"))
        .when(F.col("settled") == FAIL, F.lit("error"))
        .otherwise(F.lit("pending"))
    )
    every = events.select("entity_id").distinct()
    return every.join(folded, "entity_id", "left").select(
        "entity_id", status.alias("status"), F.coalesce("removed", F.lit(False)).alias("removed")
    )


# --- definitions ------------------------------------------------------------


def disable_events(definitions: DataFrame, removed_sources: DataFrame) -> DataFrame:
    """One disable event per enabled definition of a removed source."""
    gone = removed_sources.select("source_id").distinct()
    return (
        definitions.where("enabled")
        .join(gone, "source_id", "left_semi")
        .select("definition_id", "source_id", F.lit("disable").alias("event"))
    )


def fold_updates(base: DataFrame, patches: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Apply partial updates in order: an absent attribute keeps its value.

    ``patches`` has the key, ``seq`` and the attributes, null where absent.
    """
    newest = patches.groupBy(key).agg(
        *[
            F.max_by(a, F.when(F.col(a).isNotNull(), F.col("seq"))).alias(f"_{a}")
            for a in attributes
        ]
    )
    values = [F.coalesce(f"_{c}", c).alias(c) if c in attributes else F.col(c) for c in base.columns]
    return base.join(newest, key, "left").select(*values)
