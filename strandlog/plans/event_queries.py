"""The registered queries of the event log, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlog.functions import names, payload
from strandlog.operators import catalog, grouped, links, paging, reads, writes
from strandlog.schema import Stream
from strandlog.sources.event_log import log_from_events, log_without_revisions, numbered_page, originals, purchase_links, read_events

Query = Callable[[SparkSession, str], DataFrame]

LOG_SQL = """
WITH base AS (SELECT CAST(event_id + 1 AS BIGINT) AS global_position,
  CASE user_id % 3 WHEN 0 THEN 'FooCtx' WHEN 1 THEN 'BarCtx' ELSE 'BazCtx' END AS context,
  CASE WHEN user_id % 2 = 0 THEN 'User' ELSE 'Account' END AS stream_name,
  CAST(user_id AS VARCHAR) AS stream_id, event_type AS type, props AS data, ts AS created_at FROM events),
log AS (SELECT global_position, context, stream_name, stream_id,
  CAST(row_number() OVER (PARTITION BY context, stream_name, stream_id ORDER BY global_position) - 1 AS INT) AS stream_revision,
  type, data, created_at, CAST(NULL AS BIGINT) AS link_global_position FROM base),
links AS (SELECT (SELECT max(global_position) FROM base) + l.global_position AS global_position, 'Projections' AS context,
  'Purchases' AS stream_name, l.context AS stream_id,
  CAST(row_number() OVER (PARTITION BY l.context ORDER BY l.global_position) - 1 AS INT) AS stream_revision,
  '$>' AS type, '{}' AS data, l.created_at, l.global_position AS link_global_position FROM log l WHERE l.type = 'purchase'),
alle AS (SELECT * FROM log UNION ALL SELECT * FROM links),
parts AS (SELECT context, stream_name, type AS event_type FROM alle
  GROUP BY GROUPING SETS ((context), (context, stream_name), (context, stream_name, type)))
"""

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL that follows LOG_SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = LOG_SQL + sql
        return f

    return add


ALL = Stream.all()
USER_6 = Stream("FooCtx", "User", "6")
MIXED = {"streams": [{"context": "FooCtx"}, {"context": "BarCtx", "stream_name": "User"}, {"context": "BazCtx", "stream_name": "User", "stream_id": "2"}], "event_types": ["click", "view"]}
MIXED_SQL = "((context = 'FooCtx') OR (context = 'BarCtx' AND stream_name = 'User') OR (context = 'BazCtx' AND stream_name = 'User' AND stream_id = '2')) AND type IN ('click', 'view')"


def _page(spark: SparkSession, sf_dir: str, page: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A page of the log by position: cut first, then numbered."""
    log = log_without_revisions(spark, sf_dir)
    return numbered_page(page(log), log)


# ---- reads


@query("SELECT * FROM alle ORDER BY global_position LIMIT 1000")
def read_all_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, lambda log: reads.read(log, ALL))


@query("SELECT * FROM alle WHERE global_position <= 7000 ORDER BY global_position DESC LIMIT 50")
def read_all_backwards_from_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, lambda log: reads.read(log, ALL, {"direction": "Backwards", "from_position": 7000, "max_count": 50}))


@query("SELECT * FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6' AND stream_revision <= 20 ORDER BY stream_revision DESC LIMIT 10")
def read_stream_backwards_from_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read(log_from_events(spark, sf_dir), USER_6, {"direction": "desc", "from_revision": 20, "max_count": 10})


@query("SELECT * FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6' AND type IN ('click', 'error') ORDER BY stream_revision LIMIT 1000")
def read_stream_by_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read(log_from_events(spark, sf_dir), USER_6, {"filter": {"event_types": ["click", "error"]}, "from_position": 99999})


@query("SELECT * FROM alle WHERE stream_revision = 0 ORDER BY global_position LIMIT 1000")
def system_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.read(log_from_events(spark, sf_dir), Stream.system("$streams"))


@query(f"SELECT * FROM alle WHERE {MIXED_SQL} AND global_position >= 500 ORDER BY global_position LIMIT 200")
def filter_streams_and_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, lambda log: reads.read(log, ALL, {"filter": MIXED, "from_position": 500, "max_count": 200}))


@query("SELECT * FROM alle ORDER BY global_position LIMIT 100")
def invalid_stream_filters_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, lambda log: reads.read(log, ALL, {"filter": {"streams": [{"stream_name": "User"}, 7], "event_types": [None]}, "max_count": 100, "from_revision": 3}))


@query("SELECT context, stream_name, stream_id, CAST(max(stream_revision) AS INT) AS stream_revision FROM alle GROUP BY ALL")
def stream_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.stream_heads(log_from_events(spark, sf_dir))


@query("SELECT * FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND type = 'view' AND global_position = (SELECT max(global_position) FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND type = 'view')")
def reload_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_without_revisions(spark, sf_dir)
    last = log.where("context = 'FooCtx' and stream_name = 'User' and type = 'view'").agg(F.max("global_position")).first()[0]
    return numbered_page(reads.reload_event(log, {"context": "FooCtx", "stream_name": "User", "type": "view", "global_position": last}), log)


@query("SELECT CAST(count(*) > 0 AS BOOLEAN) AS found, context FROM alle WHERE type = 'purchase' GROUP BY context")
def event_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    return log.where(F.col("type") == "purchase").select("context").distinct().select(F.lit(True).alias("found"), "context")


TYPES = ("click", "purchase", "refund", "signup", "$>")


@query(f"SELECT v.type, v.type IN (SELECT type FROM alle) AS present FROM (VALUES {', '.join(f'({t!r})' for t in TYPES)}) v(type)")
def event_type_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_without_revisions(spark, sf_dir)
    return spark.createDataFrame([(t, reads.exists(log, F.col("type") == t)) for t in TYPES], "type string, present boolean")


# ---- grouped


GROUP = "row_number() OVER (PARTITION BY context, stream_name, type ORDER BY global_position {})"
STAR = "global_position, context, stream_name, stream_id, stream_revision, type, data, created_at, link_global_position"


@query(f"SELECT {STAR} FROM (SELECT *, {GROUP.format('DESC')} AS rn FROM alle WHERE global_position <= 5000) WHERE rn = 1")
def grouped_all_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(log_from_events(spark, sf_dir), ALL, {"direction": "Backwards", "from_position": 5000})


@query(f"SELECT {STAR} FROM (SELECT *, {GROUP.format('DESC')} AS rn FROM alle) WHERE rn = 1")
def grouped_all_newest_of_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(log_from_events(spark, sf_dir), ALL, {"direction": "Backwards"})


@query(f"SELECT {STAR} FROM (SELECT *, {GROUP.format('ASC')} AS rn FROM alle) WHERE rn = 1")
def grouped_all_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(log_from_events(spark, sf_dir), ALL)


@query(f"SELECT {STAR} FROM (SELECT *, row_number() OVER (PARTITION BY context, stream_name, type, stream_id ORDER BY global_position) AS rn FROM alle WHERE (context, stream_name, stream_id) IN (('FooCtx', 'User', '6'), ('FooCtx', 'User', '12'))) WHERE rn = 1")
def grouped_all_by_stream_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = [{"context": "FooCtx", "stream_name": "User", "stream_id": x} for x in ("6", "12")]
    return grouped.read_grouped(log_from_events(spark, sf_dir), ALL, {"filter": {"streams": pair}})


@query(f"SELECT {STAR} FROM (SELECT *, {GROUP.format('ASC')} AS rn FROM alle WHERE {MIXED_SQL}) WHERE rn = 1")
def grouped_all_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(log_from_events(spark, sf_dir), ALL, {"filter": MIXED})


@query(f"SELECT {STAR} FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY stream_revision) AS rn FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6' AND stream_revision >= 3) WHERE rn = 1")
def grouped_stream_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.read_grouped(log_from_events(spark, sf_dir), USER_6, {"from_revision": 3})


# ---- links

RESOLVED = """SELECT coalesce(o.global_position, l.global_position) AS global_position, coalesce(o.context, l.context) AS context,
  coalesce(o.stream_name, l.stream_name) AS stream_name, coalesce(o.stream_id, l.stream_id) AS stream_id,
  coalesce(o.stream_revision, l.stream_revision) AS stream_revision, coalesce(o.type, l.type) AS type, coalesce(o.data, l.data) AS data,
  CASE WHEN o.global_position IS NULL THEN l.global_position ELSE l.global_position END AS cursor
  FROM {} l LEFT JOIN {} o ON l.link_global_position = o.global_position"""
_RESOLVED = ("global_position", "context", "stream_name", "stream_id", "stream_revision", "type", "data", "cursor")


def _resolved(page: DataFrame, log: DataFrame) -> DataFrame:
    return links.cursor_position(links.resolve_links(page, log)).select(*_RESOLVED)


@query(RESOLVED.format("alle", "log"))
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    return _resolved(log, log)


@query(RESOLVED.format("links", "(SELECT * FROM log WHERE context <> 'BarCtx')"))
def resolve_dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    return _resolved(purchase_links(events), originals(events).where(F.col("context") != "BarCtx"))


@query(RESOLVED.format("(SELECT * FROM links WHERE stream_id = 'FooCtx' ORDER BY stream_revision LIMIT 100)", "log"))
def read_projection_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    stream = Stream("Projections", "Purchases", "FooCtx")
    return links.cursor_position(reads.read(log, stream, {"max_count": 100, "resolve_link_tos": True})).select(*_RESOLVED)


@query("SELECT l.link_global_position AS global_position FROM links l ANTI JOIN (SELECT * FROM log WHERE stream_name = 'User') o ON o.global_position = l.link_global_position")
def link_presence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    wanted = purchase_links(events).select(F.col("link_global_position").alias("global_position"))
    return reads.missing(wanted, originals(events).where(F.col("stream_name") == "User"))


@query("SELECT l.link_global_position AS global_position FROM links l SEMI JOIN (SELECT * FROM log WHERE stream_name = 'User') o ON o.global_position = l.link_global_position")
def positions_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    wanted = purchase_links(events).select(F.col("link_global_position").alias("global_position"))
    return reads.present(wanted, originals(events).where(F.col("stream_name") == "User"))


# ---- catalogue


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.partitions(log_from_events(spark, sf_dir))


PART = "SELECT context, stream_name, event_type FROM parts"


@query(PART)
def partitions_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).drop("id", "table_name")


@query("""SELECT context, stream_name, event_type, CASE WHEN event_type IS NOT NULL THEN 'event_types_' || md5(context || '-' || stream_name || '-' || event_type)[1:6]
  WHEN stream_name IS NOT NULL THEN 'stream_names_' || md5(context || '-' || stream_name)[1:6] ELSE 'contexts_' || md5(context)[1:6] END AS table_name FROM parts""")
def partition_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalog(spark, sf_dir).drop("id")


LEAVES = "SELECT * FROM parts WHERE event_type IS NOT NULL AND (context = 'FooCtx' OR (context = 'BarCtx' AND stream_name = 'User'))"
SCOPED = {"streams": [{"context": "FooCtx"}, {"context": "BarCtx", "stream_name": "User", "stream_id": "4"}]}


@query(f"{PART} WHERE event_type IS NOT NULL AND event_type IN ('click', 'view') AND (context = 'FooCtx' OR (context = 'BarCtx' AND stream_name = 'User'))")
def partitions_scope_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_partitions(_catalog(spark, sf_dir), {"filter": {**SCOPED, "event_types": ["click", "view"]}}).drop("id", "table_name")


@query(f"{PART} WHERE event_type IS NULL AND stream_name IS NOT NULL AND (context, stream_name) IN (SELECT context, stream_name FROM ({LEAVES}))")
def partitions_scope_stream_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_partitions(_catalog(spark, sf_dir), {"filter": SCOPED}, "stream_name").drop("id", "table_name")


@query(f"{PART} WHERE stream_name IS NULL AND context IN (SELECT context FROM ({LEAVES}))")
def partitions_scope_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_partitions(_catalog(spark, sf_dir), {"filter": SCOPED}, "context").drop("id", "table_name")


@query(f"{PART} WHERE event_type IS NULL AND stream_name IS NOT NULL AND (context, stream_name) IN (SELECT context, stream_name FROM ({LEAVES}))")
def partitions_scope_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.find_partitions(_catalog(spark, sf_dir), {"filter": SCOPED}, "auto").drop("id", "table_name")


@query(f"{PART} WHERE context = 'FooCtx' AND stream_name = 'User' AND event_type IS NULL")
def partition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.lookup(_catalog(spark, sf_dir), "FooCtx", "User").drop("id", "table_name")


@query(f"{PART} WHERE event_type = 'click' OR (event_type IS NULL AND stream_name = 'User')")
def partitions_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _catalog(spark, sf_dir)
    ids = [r.id for r in parts.where("event_type = 'click' or (event_type is null and stream_name = 'User')").select("id").collect()]  # a row for each context
    return catalog.find_by_ids(parts, ids).drop("id", "table_name")


NAMED = ("FooCtx", "QuxCtx")


@query(f"SELECT c.context, c.context IN (SELECT context FROM parts) AS taken FROM (VALUES {', '.join(f'({c!r})' for c in NAMED)}) c(context)")
def partition_name_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _catalog(spark, sf_dir)
    return spark.createDataFrame([(c, catalog.name_taken(parts, f"contexts_{md5(c.encode()).hexdigest()[:6]}")) for c in NAMED], "context string, taken boolean")


# ---- paging, search, counts


@query("SELECT DISTINCT event_type FROM parts WHERE event_type ILIKE '%I%' ORDER BY 1 LIMIT 10")
def search_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.search_event_types(_catalog(spark, sf_dir), "I")


@query("SELECT DISTINCT context FROM parts WHERE context ILIKE '%b%' AND context <= 'BazCtx' ORDER BY 1 DESC LIMIT 10")
def search_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.search_contexts(_catalog(spark, sf_dir), "b", start="BazCtx", direction="desc")


@query("SELECT DISTINCT stream_name FROM parts WHERE context = 'FooCtx' AND stream_name ILIKE '%_%' ORDER BY 1 LIMIT 10")
def search_stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.search_stream_names(_catalog(spark, sf_dir), "FooCtx", "_")


@query("SELECT DISTINCT stream_id FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND stream_id LIKE '1%' AND stream_id >= '12' ORDER BY 1 LIMIT 10")
def search_stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.search_stream_ids(log_from_events(spark, sf_dir), "FooCtx", "User", "1", start="12")


PAGE = {"filter": {"streams": [{"context": "FooCtx"}]}, "from_position": 300, "max_count": 20}


@query("SELECT * FROM alle WHERE context = 'FooCtx' AND global_position <= 300 ORDER BY global_position DESC LIMIT 20")
def events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, lambda log: paging.events_page(log, ALL, PAGE))


@query("SELECT global_position FROM alle WHERE context = 'FooCtx' AND global_position >= 300 ORDER BY 1 LIMIT 1 OFFSET 20")
def next_page_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.next_page_id(log_from_events(spark, sf_dir), ALL, PAGE)


@query("SELECT min(global_position) AS global_position FROM (SELECT global_position FROM alle WHERE context = 'FooCtx' AND global_position <= 300 ORDER BY 1 DESC LIMIT 20 OFFSET 1)")
def prev_page_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.prev_page_id(log_from_events(spark, sf_dir), ALL, PAGE)


@query(f"SELECT count(*) AS count_all FROM alle WHERE {MIXED_SQL}")
def total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.total_count(log_from_events(spark, sf_dir), ALL, {"filter": MIXED})


@query("SELECT global_position, stream_revision FROM alle WHERE context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6'")
def paginate_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir).where("context = 'FooCtx' and stream_name = 'User' and stream_id = '6'")
    size = log.count() // 4 + 1  # four pages at every scale
    out = None
    for page in paging.paginated(log, USER_6, {"max_count": size}, check=False):
        rows = page.select("global_position", "stream_revision")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT global_position, stream_revision FROM alle")
def paginate_all_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    size = log.count() // 4 + 1  # four pages at every scale
    pages = [page.select("global_position", "stream_revision") for page in paging.paginated(log, ALL, {"max_count": size, "direction": "desc"})]
    return reduce(DataFrame.unionByName, pages)


# ---- writes, as batches over the log


@query("SELECT * REPLACE (CAST(CASE WHEN context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6' AND stream_revision > 5 THEN stream_revision - 1 ELSE stream_revision END AS INT) AS stream_revision) FROM alle WHERE NOT (context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6' AND stream_revision = 5)")
def delete_event_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.without_event(log_from_events(spark, sf_dir), USER_6, 5)


@query("SELECT * FROM alle WHERE NOT (context = 'FooCtx' AND stream_name = 'User' AND stream_id = '6')")
def delete_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.without_stream(log_from_events(spark, sf_dir), USER_6)


# a batch appended to every user's stream: one 'seen' event for each of its errors
BATCH = """, mx AS (SELECT max(global_position) AS m FROM alle), heads AS (SELECT context, stream_name, stream_id, max(stream_revision) AS head FROM log GROUP BY ALL),
batch AS (SELECT l.context, l.stream_name, l.stream_id, l.global_position AS cause, row_number() OVER (PARTITION BY l.context, l.stream_name, l.stream_id ORDER BY l.global_position) AS k,
  row_number() OVER (ORDER BY l.global_position) AS n FROM log l WHERE l.type = 'error')
SELECT CAST(m + n AS BIGINT) AS global_position, context, stream_name, stream_id, CAST(head + k AS INT) AS stream_revision, 'seen' AS type, cause
FROM batch JOIN heads USING (context, stream_name, stream_id), mx"""


@query(BATCH)
def append_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    own = originals(read_events(spark, sf_dir))
    batch = own.where(F.col("type") == "error").select("context", "stream_name", "stream_id", F.lit("seen").alias("type"), F.col("global_position").alias("cause"))
    return writes.numbered_batch(batch, "cause", reads.stream_heads(own), log.agg(F.max("global_position")).first()[0])


@query("SELECT context, stream_name, stream_id, CAST(CASE WHEN head >= 20 THEN 'ok' ELSE 'conflict' END AS VARCHAR) AS outcome FROM (SELECT context, stream_name, stream_id, max(stream_revision) AS head FROM log GROUP BY ALL)")
def append_expected_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = reads.stream_heads(originals(read_events(spark, sf_dir)))
    wanted = heads.select("context", "stream_name", "stream_id", F.when(F.col("stream_revision") >= 20, F.col("stream_revision")).otherwise(F.lit(20)).alias("expected"))
    return writes.check_expected(wanted, heads)


EXPECTED = """, heads AS (SELECT context, stream_name, stream_id, max(stream_revision) AS head FROM log GROUP BY ALL),
wanted AS (SELECT *, CASE CAST(stream_id AS BIGINT) % 4 WHEN 0 THEN 'any' WHEN 1 THEN 'no_stream' WHEN 2 THEN 'stream_exists' ELSE '7' END AS expected FROM (
  SELECT context, stream_name, stream_id FROM heads UNION ALL SELECT context, 'Ghost', stream_id FROM heads))
SELECT w.context, w.stream_name, w.stream_id, CASE WHEN CASE expected WHEN 'any' THEN true WHEN 'no_stream' THEN head IS NULL WHEN 'stream_exists' THEN head IS NOT NULL
  ELSE coalesce(head, -1) = 7 END THEN 'ok' ELSE 'conflict' END AS outcome FROM wanted w LEFT JOIN heads h USING (context, stream_name, stream_id)"""


@query(EXPECTED)
def append_expected_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = reads.stream_heads(originals(read_events(spark, sf_dir)))
    streams = heads.select("context", "stream_name", "stream_id")
    ghosts = streams.withColumn("stream_name", F.lit("Ghost"))
    kind = F.col("stream_id").cast("long") % 4
    expected = F.when(kind == 0, "any").when(kind == 1, "no_stream").when(kind == 2, "stream_exists").otherwise("7")
    return writes.check_expected(streams.unionByName(ghosts).withColumn("expected", expected), heads)


# ---- subscriptions

FEED = """SELECT * FROM (SELECT {S}, 1 AS runner_id FROM alle WHERE type IN ('click', 'view') AND global_position > 100 AND global_position <= {P} ORDER BY global_position LIMIT 10)
UNION ALL SELECT * FROM (SELECT {S}, 2 AS runner_id FROM alle WHERE context = 'Projections' AND global_position > 0 AND global_position <= {P} ORDER BY global_position LIMIT 10)"""


@query(FEED.format(S=STAR, P="(SELECT max(global_position) - 5 FROM alle)"))
def subscription_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_without_revisions(spark, sf_dir)
    safe = log.agg(F.max("global_position")).first()[0] - 5
    runners = [{"runner_id": 1, "from_position": 100, "options": {"filter": {"event_types": ["click", "view"]}, "max_count": 10}}, {"runner_id": 2, "from_position": 0, "options": {"filter": {"streams": [{"context": "Projections"}]}, "max_count": 10}}]
    return numbered_page(reads.subscription_feed(log, runners, safe), log)


@query("""SELECT CAST(max(hi) AS BIGINT) AS safe_position FROM (SELECT v, max(global_position) AS hi, min(CASE WHEN user_id % 97 = 0 AND event_id % 1000 = 999 THEN v END) AS o
  FROM (SELECT event_id // 100 AS v, event_id + 1 AS global_position, user_id, event_id FROM events) GROUP BY v) WHERE v < coalesce((SELECT min(event_id // 100) FROM events WHERE user_id % 97 = 0 AND event_id % 1000 = 999), 9223372036854775807)""")
def safe_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_events(spark, sf_dir)
    commits = events.groupBy(F.floor(F.col("event_id") / 100).alias("version")).agg(F.max(F.col("event_id") + 1).alias("max_position"), F.max((F.col("user_id") % 97 == 0) & (F.col("event_id") % 1000 == 999)).alias("is_open"))
    return writes.safe_position(commits)


# ---- subscription sets, over sets and subscriptions that the events stand for: a set for each type, a subscription for each user

SETS = """, sets AS (SELECT DISTINCT 'set-' || type AS name FROM log), subs AS (SELECT 'set-' || type AS set, stream_id AS name, CASE WHEN count(*) % 3 = 0 THEN 'running' ELSE 'stopped' END AS state,
  CASE WHEN count(*) % 2 = 0 AND type <> 'signup' THEN 'set-' || type END AS locked_by FROM log GROUP BY type, stream_id) """


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read_events(spark, sf_dir)
    name = F.concat(F.lit("set-"), F.col("event_type"))
    per = events.groupBy("event_type", F.col("user_id").cast("string").alias("name")).agg(F.count("*").alias("n"))
    subs = per.select(name.alias("set"), "name", F.when(F.col("n") % 3 == 0, "running").otherwise("stopped").alias("state"), F.when((F.col("n") % 2 == 0) & (F.col("event_type") != "signup"), name).alias("locked_by"))
    return events.select(name.alias("name")).distinct(), subs


@query(SETS + "SELECT name FROM sets UNION SELECT set FROM subs UNION SELECT DISTINCT context FROM log ORDER BY 1")
def set_names_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.streaming import state

    sets, subs = _sets(spark, sf_dir)
    contexts = originals(read_events(spark, sf_dir)).select(F.col("context").alias("set"))
    return state.set_names(sets, subs.select("set").unionByName(contexts))


@query(SETS + "SELECT name FROM sets WHERE name IN (SELECT locked_by FROM subs WHERE state = 'running')")
def sets_by_subscription_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.streaming import state

    sets, subs = _sets(spark, sf_dir)
    return state.sets_with_state(sets, subs, "running")


@query(SETS + "SELECT sets.name AS set_name, count(subs.name) AS n_subscriptions, min(subs.name) AS first_name FROM sets FULL JOIN subs ON subs.locked_by = sets.name GROUP BY 1")
def set_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.streaming import state

    found = state.associate(*_sets(spark, sf_dir))
    return found.select("set_name", F.size("subscriptions").cast("long").alias("n_subscriptions"), F.array_min("subscriptions").alias("first_name"))


@query(SETS + "SELECT DISTINCT set FROM subs WHERE state = 'stopped' ORDER BY 1")
def distinct_sets_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.streaming import state

    return state.distinct_sets(_sets(spark, sf_dir)[1], "stopped")


@query("SELECT global_position, avg(CAST(stream_revision AS DOUBLE)) OVER (PARTITION BY context, stream_name, stream_id ORDER BY stream_revision ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS average FROM log WHERE stream_name = 'User'")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = originals(read_events(spark, sf_dir)).where(F.col("stream_name") == "User")
    return writes.moving_average(log, ["context", "stream_name", "stream_id"], "stream_revision", "stream_revision").select("global_position", "average")


# ---- functions


@query("SELECT global_position, TRY_CAST(json_extract_string(data, '$.k') AS BIGINT) AS k FROM log WHERE type = 'click'")
def payload_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = payload.PayloadTypes().register("click", "k bigint").events_of(originals(read_events(spark, sf_dir)), "click")
    return typed.select("global_position", F.col("payload.k").alias("k"))


@query("SELECT context, format('{:,}', count(*)) AS shown FROM alle GROUP BY context")
def counts_formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_from_events(spark, sf_dir)
    return log.groupBy("context").agg(F.count("*").alias("n")).select("context", names.thousands(F.col("n")).alias("shown"))


@query("SELECT global_position, context, stream_name, stream_id, type FROM alle WHERE context IN ('FooCtx', 'Projections')")
def subscription_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlog.streaming.replay import replay

    return replay(log_from_events(spark, sf_dir), {"filter": {"streams": [{"context": "FooCtx"}, {"context": "Projections"}]}}).select("global_position", "context", "stream_name", "stream_id", "type")
