"""Reads over the fixture matrix, grouped reads, links, paging, catalogue; literal expected ids."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from strandlog.errors import StreamNotFoundError
from strandlog.functions import names, payload
from strandlog.operators import catalog, filters, grouped, links, paging, reads, writes
from strandlog.schema import Stream, is_descending
from strandlog.sources.event_log import dense_revisions

SCHEMA = "id string, context string, stream_name string, stream_id string, type string, global_position long, stream_revision int, data string, link_global_position long"


def log_of(spark, rows):
    """rows: (context, stream_name, stream_id, type[, link position]) in append order; ids e1, e2 ..."""
    heads: dict[tuple, int] = {}
    out = []
    for k, (c, n, i, t, *link) in enumerate(rows, 1):
        heads[c, n, i] = heads.get((c, n, i), -1) + 1
        out.append((f"e{k}", c, n, i, t, k, heads[c, n, i], "{}", link[0] if link else None))
    return spark.createDataFrame(out, SCHEMA)


def ids(df):
    return [r.id for r in df.collect()]


S1, S2 = ("SomeContext", "some-stream1", "123"), ("SomeAnotherContext", "some-stream1", "12345")
S3, S4, S5 = ("SomeContext", "some-stream2", "1234"), ("SomeAnotherContext2", "some-stream3", "1234"), ("SomeAnotherContext", "some-stream1", "1235")


@pytest.fixture(scope="module")
def matrix(spark):
    turn = [(*S1, "foo"), (*S2, "bar"), (*S3, "baz"), (*S4, "bar"), (*S5, "foo")]
    return log_of(spark, turn + turn).cache()


ALL, HEADS = Stream.all(), Stream.system("$streams")


def opts(*streams, types=None, **more):
    return {"filter": {"streams": list(streams), "event_types": types}, **more}


@pytest.mark.parametrize(
    ("stream", "options", "want"),
    [
        (Stream(*S1), opts({"context": "SomeContext"}), "e1 e6"),
        (ALL, opts({"context": "SomeContext"}), "e1 e3 e6 e8"),
        (HEADS, opts({"context": "SomeContext"}), "e1 e3"),
        (ALL, opts({"stream_name": "some-stream1"}), "e1 e2 e3 e4 e5 e6 e7 e8 e9 e10"),
        (HEADS, opts({"stream_name": "some-stream1"}), "e1 e2 e3 e4 e5"),
        (ALL, opts({"context": "SomeContext"}, {"stream_name": "x"}), "e1 e3 e6 e8"),
        (ALL, opts({"context": "SomeAnotherContext", "stream_name": "some-stream1", "stream_id": "1235"}, types=["foo"]), "e5 e10"),
        (ALL, opts(types=["foo", "baz"], direction="Backwards", from_position=8), "e8 e6 e5 e3 e1"),
        (ALL, opts(types=["nothing"]), ""),
        (ALL, {"max_count": 2, "direction": "unknown", "from_revision": 5}, "e1 e2"),
        (Stream(*S1), {"direction": "desc", "from_position": 1}, "e6 e1"),
        (Stream(*S1), {"from_revision": 1}, "e6"),
        (Stream(*S1), opts(types=["bar"]), ""),
        (ALL, {"filter": {"streams": "text", "event_types": [None, 3]}, "max_count": 1}, "e1"),
    ],
)
def test_read_matrix(matrix, stream, options, want):
    assert ids(reads.read(matrix, stream, options)) == want.split()


def test_missing_streams(matrix):
    with pytest.raises(StreamNotFoundError):
        reads.read(matrix, Stream("a", "b", "c"))
    with pytest.raises(StreamNotFoundError):
        reads.read(matrix, Stream.system("$other"))
    with pytest.raises(StreamNotFoundError):
        grouped.read_grouped(matrix, Stream("a", "b", "c"))


@pytest.mark.parametrize(
    ("options", "want"),
    [
        (opts({"context": "SomeContext"}), "e1 e3"),
        (opts({"context": "SomeContext"}, from_position=6), "e6 e8"),
        (opts({"context": "SomeContext"}, from_position=4), "e6 e8"),
        (opts({"context": "SomeContext"}, direction="Backwards"), "e6 e8"),
        (opts({"context": "SomeContext"}, direction="Backwards", from_position=6), "e3 e6"),
        (opts({"stream_name": "some-stream1"}), "e1 e2 e3 e4 e5"),
        (opts({"context": "SomeAnotherContext"}, {"context": "SomeAnotherContext2"}), "e2 e4 e5"),
        (opts(dict(zip(("context", "stream_name", "stream_id"), S1, strict=True)), dict(zip(("context", "stream_name", "stream_id"), S4, strict=True))), "e1 e4"),
        (opts(dict(zip(("context", "stream_name", "stream_id"), S2, strict=True)), dict(zip(("context", "stream_name", "stream_id"), S5, strict=True))), "e2 e5"),
        (opts({"context": "nowhere"}), ""),
    ],
)
def test_grouped(matrix, options, want):
    assert sorted(ids(grouped.read_grouped(matrix, ALL, options))) == sorted(want.split())


def test_grouped_by_type_and_stream(spark):
    log = log_of(spark, [("FooCtx", "Foo", "1", "Foo"), ("FooCtx", "Foo", "1", "Bar"), ("FooCtx", "Foo", "2", "Baz"), ("FooCtx", "Foo", "3", "Foo"), ("FooCtx", "Foo", "3", "Baz"), ("FooCtx", "Foo", "1", "Foo")])
    assert set(ids(grouped.read_grouped(log, ALL))) == {"e1", "e2", "e3"}
    assert set(ids(grouped.read_grouped(log, ALL, {"direction": "Backwards"}))) == {"e6", "e2", "e5"}
    one = Stream("FooCtx", "Foo", "1")
    assert set(ids(grouped.read_grouped(log, one))) == {"e1", "e2"}
    assert set(ids(grouped.read_grouped(log, one, {"from_revision": 1}))) == {"e2", "e6"}
    assert set(ids(grouped.read_grouped(log, one, {"direction": "desc"}))) == {"e2", "e6"}


def test_links(spark):
    log = log_of(spark, [("FooCtx", "Foo", "1", "Foo"), ("FooCtx", "Foo", "1", "Bar"), ("P", "Q", "1", "$>", 1), ("P", "Q", "1", "$>", 2), ("P", "Q", "1", "$>", 99)])
    projection = Stream("P", "Q", "1")
    page = reads.read(log, projection).withColumn("runner_id", F.lit(7))
    rows = {r.cursor: r for r in links.cursor_position(links.resolve_links(page, log)).collect()}
    assert [(rows[k].id, rows[k].runner_id) for k in (3, 4, 5)] == [("e1", 7), ("e2", 7), ("e5", 7)]
    assert rows[3].link.id == "e3" and rows[5].link is None
    assert sorted(ids(grouped.read_grouped(log, projection, {"resolve_link_tos": True}))) == ["e1"]
    keys = spark.createDataFrame([(1,), (99,)], "global_position long")
    assert [r[0] for r in reads.missing(keys, log).collect()] == [99] and [r[0] for r in reads.present(keys, log).collect()] == [1]


def test_rows_that_are_no_links_are_spread(spark):
    rows = [("FooCtx", "Foo", str(k % 7), "Foo") for k in range(1000)]
    log = log_of(spark, [*rows, ("P", "Q", "1", "$>", 1), ("P", "Q", "1", "$>", 1), ("P", "Q", "1", "$>", 1001), ("P", "Q", "1", "$>", 9999)])
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        got = links.resolve_links(log, log).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(Counter(r.task for r in got).values()) < 500
    # a row that is no link stays as it is, also where links point at it; a link to a link is resolved once
    found = {r.link.id: r.id for r in got if r.link}
    assert found == {"e1001": "e1", "e1002": "e1", "e1003": "e1001"}
    assert sorted(r.id for r in got if not r.link) == sorted([*(f"e{k}" for k in range(1, 1001)), "e1004"])


def test_pages(spark):
    log = log_of(spark, [("FooCtx", "My", "1", "Foo"), ("FooCtx", "My", "1", "Bar"), ("FooCtx", "My", "2", "Foo"), ("BarCtx", "My", "1", "Bar"), ("BarCtx", "My", "1", "Baz")])
    one = lambda df: [r[0] for r in df.collect()]
    asc = {"max_count": 2, "direction": "asc"}
    assert ids(paging.events_page(log, ALL, asc)) == ["e1", "e2"]
    assert one(paging.next_page_id(log, ALL, asc)) == [3] and one(paging.next_page_id(log, ALL, {**asc, "from_position": 3})) == [5]
    assert one(paging.next_page_id(log, ALL, {**asc, "from_position": 5})) == []
    assert one(paging.next_page_id(log, ALL, {"max_count": 2, "direction": "desc", "from_position": 3})) == [1]
    assert one(paging.prev_page_id(log, ALL, {**asc, "from_position": 5})) == [3] and one(paging.prev_page_id(log, ALL, {**asc, "from_position": 1})) == []
    assert paging.estimated_count(log, ALL, {}) == (5, True) and paging.estimated_count(log, ALL, {}, above=2)[0] == 5
    assert [ids(p) for p in paging.paginated(log, ALL, {"max_count": 2})] == [["e1", "e2"], ["e3", "e4"], ["e5"]]
    assert [ids(p) for p in paging.paginated(log, ALL, {"max_count": 2, "direction": "desc"})] == [["e5", "e4"], ["e3", "e2"], ["e1"]]
    assert [ids(p) for p in paging.paginated(log, Stream("FooCtx", "My", "1"), {"max_count": 1, "direction": "desc"})] == [["e2"], ["e1"]]
    cat = catalog.partitions(log)
    assert one(paging.search_contexts(cat, "CTX")) == ["BarCtx", "FooCtx"] and one(paging.search_event_types(cat, "ba")) == ["Bar", "Baz"]
    assert one(paging.search_stream_ids(log, "FooCtx", "My", "")) == ["1", "2"]
    assert paging.per_page("50") == 50 and paging.per_page(3) == 10 and paging.per_page(None) == 10


def test_catalog(spark):
    log = log_of(spark, [("SomeCtx", "SomeStream", "1", "SomethingChanged"), ("", "", "1", "x"), ("A", "N", "1", "t"), ("A", "M", "1", "t")])
    cat = catalog.partitions(log)
    names_ = {(r.context, r.stream_name, r.event_type): r.table_name for r in cat.collect()}
    # fixed values: documented names for these parts
    assert names_["SomeCtx", None, None] == "contexts_81820a"
    assert names_["SomeCtx", "SomeStream", None] == "stream_names_ecb803"
    assert names_["SomeCtx", "SomeStream", "SomethingChanged"] == "event_types_aeadd5"
    assert len(names_) == 3 + 4 + 4
    pick = lambda o, s: sorted((r.context, r.stream_name, r.event_type) for r in catalog.find_partitions(cat, o, s).collect())
    assert pick(opts({"context": "A"}), "context") == [("A", None, None)]
    assert pick(opts({"context": "A", "stream_name": "M", "stream_id": "9"}), "auto") == [("A", "M", None)]
    assert pick(opts({"context": "A"}, types=["t"]), "auto") == [("A", "M", "t"), ("A", "N", "t")]
    assert len(pick(opts({"stream_name": "M"}), "event_type")) == 4
    assert catalog.lookup(cat, "", "").count() == 1 and catalog.name_taken(cat, "contexts_81820a") and not catalog.name_taken(cat, "x")
    some = [r.id for r in cat.limit(2).collect()]
    assert catalog.find_by_ids(cat, some).count() == 2 and catalog.find_by_ids(cat, []).count() == 0
    with pytest.raises(ValueError):
        catalog.find_partitions(cat, {}, "other")


def test_directions_and_filters():
    assert [is_descending(x) for x in ("desc", "Backwards", "DESC", "asc", "Forwards", None, 3)] == [True, True, True, False, False, False, False]
    assert filters.stream_filters({"filter": {"streams": [{"context": "a", "stream_id": "b"}, {"context": 1}, "x", {"context": "a", "other": "b"}]}}) == []
    assert filters.event_types({"filter": {"event_types": "foo"}}) == []


def test_functions(spark):
    df = spark.createDataFrame([("FooBarBAZQux", 1234567, '{"a": {"b": 3}, "a": {"b": 4}}')], "s string, n long, j string")
    r = df.select(names.snake_case(F.col("s")), names.thousands(F.col("n")), payload.get(F.lit('{"a": {"b": 3}}'), "$.a.b", "int")).first()
    assert tuple(r) == ("foo_bar_baz_qux", "1,234,567", 3)
    r = spark.range(1).select(names.is_live(F.current_timestamp() - F.expr("interval 5 seconds"), F.current_timestamp(), 10.0), names.is_live(F.current_timestamp() - F.expr("interval 12 seconds"), F.current_timestamp(), 10.0)).first()
    assert tuple(r) == (True, False)


def test_safe_position(spark):
    commits = spark.createDataFrame([(1, 10, False), (2, 20, False), (3, 30, True), (4, 40, False)], "version long, max_position long, is_open boolean")
    assert writes.safe_position(commits).first()[0] == 20
    assert writes.safe_position(commits.where("version < 3")).first()[0] == 20 and writes.safe_position(commits.limit(0)).first()[0] == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 5_000_000)), unique_by=lambda x: x[1], max_size=25))
def test_dense_revisions_property(spark, rows):
    df = spark.createDataFrame([(k, p) for k, p in rows], "k string, global_position long")
    got = {(r.k, r.global_position): r.stream_revision for r in dense_revisions(df, ["k"]).collect()}
    want = {}
    for k in "ab":
        want |= {(k, p): n for n, p in enumerate(sorted(p for x, p in rows if x == k))}
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("AB"), st.sampled_from("xy"), st.sampled_from("12"), st.sampled_from("st")), min_size=1, max_size=15), st.booleans())
def test_grouped_property(spark, rows, down):
    log = log_of(spark, rows)
    got = set(ids(grouped.read_grouped(log, ALL, {"direction": "desc" if down else "asc"})))
    best: dict[tuple, int] = {}
    for k, (c, n, _, t) in enumerate(rows, 1):
        key = (c, n, t)
        best[key] = max(best.get(key, k), k) if down else min(best.get(key, k), k)
    assert got == {f"e{k}" for k in best.values()}
