"""Near duplicates against all pairs by brute force; sketches, components, and hot groups."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from strandlog.llm import near_dup, queries, shingles as sh
from strandlog.llm.common import Scratch
from strandlog.llm.components import connected_components
from tests.conftest import SF

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(_LOWER))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    flat = [(i, s) for i, ss in sets.items() for s in ss]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat.sort(key=lambda r: len(r[1]))
    for k, (a, x) in enumerate(flat):
        for b, y in reversed(flat[:k]):
            if 100 * len(y) < percent * len(x):
                break  # the sizes alone say that no smaller set is alike
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((i, len(s), find(i)) for i, s in flat)


def run(docs, width, percent=80):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs, width, percent).collect())


@pytest.mark.parametrize("width", [4, 5])
def test_against_all_pairs(spark, width):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert run(docs, width) == brute([(r.doc_id, r.text) for r in docs.collect()], width)


def test_query_against_all_pairs(spark):
    """op2 as registered, on 1000 documents: every document's class is that of all pairs."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op2_minhash_near_dedup(spark, sf).collect())
    want = brute(rows, 4)
    assert got == want and sum(d != c for d, _, c in want) > 50


def chain(n, step=3, length=40):
    """Texts of which neighbours are alike, and far ones are not: one component that no star around one text shows."""
    words = [f"w{k}" for k in range(n * step + length)]
    return [(k + 1, " ".join(words[k * step : k * step + length])) for k in range(n)]


def test_hot_groups(docs_of):
    rng = random.Random(5)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join(base)) for k in range(100, 140)]  # copies
    for k in range(200, 260):  # copies with an edit each, alike to the first but less to each other
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(text)))
    shared = " ".join(f"s{k}" for k in range(30))
    rows += [(k, shared + " " + " ".join(f"o{k}x{j}" for j in range(20))) for k in range(300, 380)]  # a passage in common
    rows += chain(30)
    docs = docs_of(rows)
    assert run(docs, 4) == brute(rows, 4)


@pytest.mark.parametrize("few", [0, 3])
def test_blocks_of_a_bucket(docs_of, monkeypatch, few):
    """With tiny blocks, a bucket's members are compared over many of them."""
    monkeypatch.setattr(near_dup, "OUTSIDE", 2)
    monkeypatch.setattr(near_dup, "INSIDE", 3)
    monkeypatch.setattr(near_dup, "FEW", few)
    rng = random.Random(6)
    rows = []
    for g in range(2):
        base = [f"g{g}w{k}" for k in range(60)]
        for k in range(25):
            text = list(base)
            for _ in range(3):
                text[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            rows.append((100 * g + k, " ".join(text)))
    assert run(docs_of(rows), 4) == brute(rows, 4)


def test_edges(docs_of):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, "x"), (7, "x"), (None, "x"), (8, "q " * 5000), (9, "q " * 7000), (None, "alone here")]
    got = {}
    for r in near_dup.near_duplicates(docs_of(rows), 4).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] and got[6] == [(1, 6, True)]
    assert got[7] == [(1, 7, True)] * 2 and sorted(got[None], key=str) == sorted([(1, 7, False), (1, None, True)], key=str)
    assert got[8] == [(1, 8, True)] and got[9] == [(1, 8, False)]
    assert near_dup.near_duplicates(docs_of([])).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 2000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n - n // 5], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)])
        sketch = sh.similarity_sketches(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, n, 2 * n]), 128)
        assert (sketch != np.iinfo(np.uint64).max).all()
        true = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((sketch[0] == sketch[1]).mean() - true) < 0.15


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (150, 300), (7, 7)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect())
    assert all(got[k] == 1 for k in range(1, 61)) and {got[k] for k in (100, 150, 200, 300)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_long_texts_are_hashed_in_stretches(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(50)}" for _ in range(n)) for n in (0, 1, 300, 2, 700)] + ["x" * 400 + " y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    want = sh.word_hashes(raw, offsets)
    for size in (1, 10, 333):
        monkeypatch.setattr(sh, "AT_ONCE", size)
        got = sh.word_hashes(raw, offsets)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
