"""The driver's ``events`` table as an event log: streams by user, and a projection stream of links per context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlog.operators.writes import dense_numbers
from strandlog.schema import LINK_TYPE, STREAM_KEYS

def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def dense_revisions(events: DataFrame, keys: list[str], order: str = "global_position") -> DataFrame:
    """``events`` with stream_revision: 0, 1, 2 ... in each stream by ``order``; a hot stream is spread over many tasks."""
    return dense_numbers(events, keys, order, "_number").withColumn("stream_revision", (F.col("_number") - 1).cast("int")).drop("_number")


def base_events(events: DataFrame) -> DataFrame:
    """Positions, stream keys and payload of the driver's events; no revisions, hence no shuffle."""
    user = F.col("user_id")
    context = F.when(user % 3 == 0, "FooCtx").when(user % 3 == 1, "BarCtx").otherwise("BazCtx")
    return events.select(
        (F.col("event_id") + 1).cast("long").alias("global_position"),
        context.alias("context"),
        F.when(user % 2 == 0, "User").otherwise("Account").alias("stream_name"),
        user.cast("string").alias("stream_id"),
        F.col("event_type").alias("type"),
        F.col("props").alias("data"),
        F.col("ts").alias("created_at"),
        F.lit(None).cast("long").alias("link_global_position"),
    )


COLUMNS = ("global_position", "context", "stream_name", "stream_id", "stream_revision", "type", "data", "created_at", "link_global_position")
_KEYS = list(STREAM_KEYS)


def numbered_page(page: DataFrame, log: DataFrame) -> DataFrame:
    """``page``, some rows of a log without revisions, with their revisions: only the streams on the page are numbered.

    The page is one that a limit has made small; its stream keys and positions are broadcast, the log's other columns are
    never moved.
    """
    streams = F.broadcast(page.select(*_KEYS).distinct())
    own = log.select(*_KEYS, "global_position").join(streams, _KEYS, "left_semi")
    revisions = dense_revisions(own, _KEYS).select("global_position", "stream_revision")
    out = revisions.join(F.broadcast(page), "global_position")
    return out.select(*COLUMNS, *[c for c in page.columns if c not in COLUMNS])


def log_without_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in the columns of COLUMNS but stream_revision, which nothing has to be shuffled for."""
    events = read_events(spark, sf_dir)
    columns = [c for c in COLUMNS if c != "stream_revision"]
    return base_events(events).select(*columns).unionByName(_bought(events).select(*columns))


def originals(events: DataFrame) -> DataFrame:
    """The log without links."""
    return dense_revisions(base_events(events), _KEYS).select(*COLUMNS)


def _bought(events: DataFrame) -> DataFrame:
    base = base_events(events)
    last = base.agg(F.max("global_position").alias("last"))
    bought = base.where(F.col("type") == "purchase").crossJoin(F.broadcast(last))  # one row
    return bought.select(
        (F.col("last") + F.col("global_position")).alias("global_position"),
        F.lit("Projections").alias("context"),
        F.lit("Purchases").alias("stream_name"),
        F.col("context").alias("stream_id"),
        F.lit(LINK_TYPE).alias("type"),
        F.lit("{}").alias("data"),
        "created_at",
        F.col("global_position").alias("link_global_position"),
    )


def purchase_links(events: DataFrame) -> DataFrame:
    """A link to every purchase, in one projection stream per context, positioned behind the log (with gaps)."""
    return dense_revisions(_bought(events), _KEYS).select(*COLUMNS)


def log_from_events(spark: SparkSession, sf_dir: str, links: bool = True) -> DataFrame:
    """The whole log, in the columns of COLUMNS."""
    events = read_events(spark, sf_dir)
    return originals(events).unionByName(purchase_links(events)) if links else originals(events)
