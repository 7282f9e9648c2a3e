"""Near duplicates by fast similarity sketching, banding and exact verification.

1. Texts become sets of word shingles; equal sets are one class, known by a 128-bit fingerprint and named by its least
   doc_id. Everything below works on classes, so that copies cost nothing.
2. Each class has a sketch of 128 coordinates in 32 bands of 4. Two sets of similarity 0.8 share no band with probability
   (1 - 0.8^4)^32 < 1e-7.
3. The members of a bucket are paired with its least member only. Pairs whose sketches agree in fewer than
   SKETCH_LEAST coordinates are discarded (at similarity 0.8 that happens less than once in 1e8 pairs), the rest is
   verified on the full sets of their texts.
4. Verified links give components. A bucket whose members are in one component needs no more pairs. In any other, the
   members outside its largest component are compared with the bucket by their sketches, block by block inside tasks (bounded
   blocks of hashed members, each pair in the first of the bands that it shares). Alike pairs of small buckets are verified
   like the others; those of large buckets are verified where they are compared, so that only links leave the task.

No step emits the pairs of a group, gathers a group in one task, or sends more than counts to the driver.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; rows with equal
doc_id are one node; a row without doc_id joins the component of its text's class, or has a null component if no other
row has that text; other columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandlog.llm import shingles as sh
from strandlog.llm.common import BROADCAST_ROWS, Scratch, lean, slices, text_bytes
from strandlog.llm.components import connected_components

SKETCH, ROWS = 128, 4
#: Of 128 coordinates (their low bytes), those that two sketches must share to be verified.
SKETCH_LEAST = 76
#: Members outside a bucket's largest component, and members of the bucket, that are compared at once, about.
OUTSIDE, INSIDE = 64, 256
#: Blocks of a bucket's members that meet in one task; a large bucket is spread over more tasks.
TOGETHER = 8
#: Members of a bucket up to which its alike pairs leave the task to be verified; in larger ones they are verified there.
FEW = 16

_SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """For each row: doc_id, size and fingerprint of its shingle set, band keys and the low bytes of its sketch."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                sets, bounds = sh.shingle_sets(*text_bytes(part.column("text")), width)
                counts = np.diff(bounds)
                h1, h2 = sh.fingerprints(sets, bounds)
                sketch = sh.similarity_sketches(sets, bounds, SKETCH)
                bands = sh.band_keys(sketch, ROWS)
                per = np.where(counts > 0, bands.shape[1], 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), pa.array(bands[counts > 0].ravel()))
                low = (sketch & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(h1), pa.array(h2), lists, pa.array([x.tobytes() for x in low], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), _SIGNATURE)


def _alike(pairs: DataFrame) -> DataFrame:
    """Of rows (a, b, sketch_a, sketch_b), the pairs whose sketches agree in SKETCH_LEAST coordinates at least."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (2, 3))
            same = (x == y).sum(axis=1) >= SKETCH_LEAST
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(same)) for k in (0, 1)], schema=schema)

    return pairs.select("a", "b", "sketch_a", "sketch_b").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Of rows (a, b, text_a, text_b), the pairs with 100 * intersection >= percent * union on full sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray | None] = (None, None)

        def set_of(text: str) -> np.ndarray:
            raw = np.frombuffer(text.encode(), np.uint8)
            return sh.shingle_sets(raw, np.array([0, len(raw)]), width)[0]

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                text = x.as_py()
                if text != last[0]:  # rows of one representative follow each other
                    last = (text, set_of(text))
                a, b = last[1], set_of(y.as_py())
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], schema=schema)

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long")


class _Linker:
    """Turns candidate pairs of classes into verified links."""

    def __init__(self, docs: DataFrame, reps: DataFrame, scratch: Scratch, width: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long"), "text")
        self.reps, self.scratch, self.width, self.percent = reps, scratch, width, percent

    def texts(self, ids: DataFrame) -> DataFrame:
        """(doc_id, text) of the given ids (doc_id), each text of an id once."""
        ids = self.scratch.cut(ids.distinct(), "text-ids")
        if ids.count() <= BROADCAST_ROWS:
            ids = F.broadcast(ids)
        found = self.docs.where(F.col("text").isNotNull()).join(ids, "doc_id", "left_semi")
        return self.scratch.cut(found.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text")), "texts")

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs``: (a, b) with a < b."""
        sketches = self.reps.select("doc_id", "sketch")
        with_both = pairs.distinct().join(sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sketch_b")), "b").join(sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        near = self.scratch.cut(_alike(with_both), "alike")
        texts = self.texts(near.select(F.explode(F.array("a", "b")).alias("doc_id")))
        rows = near.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        out = self.scratch.cut(verified(rows, self.width, self.percent), "links")
        for t in (near, texts):
            self.scratch.drop(t)
        return out

    def across(self, members: DataFrame, components: DataFrame) -> DataFrame:
        """Links between components, of members (key, id) of the same buckets."""
        of = components.select(F.col("node").alias("id"), "component")
        placed = members.join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
        state = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
        state = self.scratch.cut(state, "open-keys")  # joined by itself, the rows of a large bucket need not meet in one task
        if state.count() <= BROADCAST_ROWS:
            state = F.broadcast(state)
        bands = self.reps.select(F.col("doc_id").alias("id"), "bands", "sketch")
        rows = self.scratch.cut(placed.join(state, "key").join(bands, "id"), "open-buckets")
        small = rows.where(F.col("n") <= FEW).withColumn("text", F.lit(""))
        found = self.links(_compared(small))
        large = rows.where(F.col("n") > FEW)
        if large.isEmpty():
            return found
        texts = self.texts(large.select(F.col("id").alias("doc_id")))
        large = large.join(texts.select(F.col("doc_id").alias("id"), "text"), "id")
        return found.unionByName(self.scratch.cut(_compared(large, self.width, self.percent), "links-of-large-buckets"))


def _compared(rows: DataFrame, width: int = 0, percent: int = 0) -> DataFrame:
    """Pairs (a, b) across components, within buckets, whose sketches are alike; with a ``width``, verified links.

    A bucket's members outside its largest component are compared with all its members, in blocks of hashed members. A
    pair counts in the bucket of the first band that it shares, so it comes about once. Of two components that one block
    has found linked, no more pairs are verified there: what counts is that they are one.
    """

    inside = F.ceil(F.col("n") / INSIDE)

    def blocks(df: DataFrame, number: Column, name: str) -> DataFrame:
        held = df.groupBy("key", number.alias("block"), "n").agg(F.collect_list(F.struct("id", "component", "bands", "sketch", "text")).alias("m"))
        return held.select("key", "block", "n", *[F.col(f"m.{c}").alias(f"{name}_{c}") for c in ("id", "component", "sketch", "text")], F.flatten("m.bands").alias(f"{name}_bands"))

    parts = F.ceil(inside / TOGETHER)
    outer = blocks(rows.where("component <> largest"), F.pmod(F.xxhash64("id"), F.ceil(F.expr("n - most") / OUTSIDE)), "x")
    outer = outer.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("block", "n")
    inner = blocks(rows, F.pmod(F.xxhash64("id"), inside), "y").withColumn("part", F.pmod("block", parts)).drop("block", "n")
    both = outer.join(inner, ["key", "part"])
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i, key in enumerate(at["key"].to_pylist()):
                number = lambda n, i=i, at=at: at[n][i].values.to_numpy()
                sketch = lambda n, i=i, at=at: np.frombuffer(b"".join(at[n][i].values.to_pylist()), np.uint8).reshape(-1, SKETCH)
                cx, cy = number("x_component"), number("y_component")
                alike = (sketch("x_sketch")[:, None] == sketch("y_sketch")[None]).sum(axis=2) >= SKETCH_LEAST
                x, y = np.nonzero(alike & (cx[:, None] != cy[None]))
                bx, by = (number(f"{s}_bands").reshape(-1, SKETCH // ROWS) for s in "xy")
                own = bx[x, (bx[x] == by[y]).argmax(axis=1)] == key
                x, y = x[own], y[own]
                if width and len(x):
                    sx, ox = sh.shingle_sets(*text_bytes(at["x_text"][i].values), width)
                    sy, oy = sh.shingle_sets(*text_bytes(at["y_text"][i].values), width)
                    keep, one = np.zeros(len(x), bool), set()
                    for k, (p, q) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                        if (cx[p], cy[q]) not in one:
                            u, v = sx[ox[p] : ox[p + 1]], sy[oy[q] : oy[q + 1]]
                            if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                                continue
                            n = len(np.intersect1d(u, v, assume_unique=True))
                            keep[k] = 100 * n >= percent * (len(u) + len(v) - n)
                            if keep[k]:
                                one.add((cx[p], cy[q]))
                    x, y = x[keep], y[keep]
                ids = np.stack([number("x_id")[x], number("y_id")[y]])
                yield pa.RecordBatch.from_arrays([pa.array(ids.min(axis=0)), pa.array(ids.max(axis=0))], schema=schema)

    return both.mapInArrow(lean(run), "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (least doc_id reachable), kept."""
    scratch = Scratch(docs.sparkSession)
    sig = scratch.cut(signatures(docs, width), "signatures")
    full = sig.where("n_shingles > 0")
    first = F.min_by(F.struct("doc_id", "bands", "sketch"), "doc_id")  # copies are one row before the shuffle
    classes = scratch.cut(full.groupBy("h1", "h2").agg(first.alias("r")).select("h1", "h2", F.col("r.doc_id").alias("rep"), "r.bands", "r.sketch"), "classes")
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "bands", "sketch")
    linker = _Linker(docs, reps, scratch, width, percent)

    rows = reps.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"))
    shared = rows.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = scratch.cut(rows.join(shared, "key"), "buckets")
    links = linker.links(buckets.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")))
    components = scratch.cut(connected_components(links, scratch), "components")

    # a bucket's least member has been compared with all others
    more = linker.across(buckets.where("id <> pivot").select("key", "id"), components)
    if not more.isEmpty():
        components = scratch.cut(connected_components(links.unionByName(more), scratch), "components")

    named = classes.select("h1", "h2", "rep").join(components.select(F.col("node").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    moved = named.where("component is not null")
    out = sig.join(moved, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
