"""Language identification, toxicity and the pipeline: held-out accuracy, exact neighbours, edge cases, stages."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlog.llm import language, near_dup, toxicity
from tests.conftest import SF

BIG = "/root/testdata/sf0.01"


# ---- language


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = language.language_digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and length(text) > 40")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] >= 0.97 and 0 <= right[1] and right[2] <= 1


def test_prediction_uses_text_only_and_whole(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    assert model.languages == ["de", "en", "es", "fr"] and model.families == ["germanic", "romance"]
    de = docs.where("lang = 'de'").first().text
    rows = [(1, de), (2, None), (3, ""), (4, "123 ... !"), (5, "1 " * 20000 + de), (6, de), (None, "x")]
    table = docs_of(rows)
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in language.identify(table, model).collect()}
    assert got[1][0] == "de" and got[1] == got[6] and got[5][0] == "de"
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[None][0] in model.languages
    assert language.identify(table, model).columns == [*table.columns, "lang_pred", "lang_score"]
    assert language.identify(docs_of([]), model).count() == 0
    # batches of any size give the same
    texts = pa.array([r[1] for r in rows])
    one = [model.predict(texts.slice(k, 1)) for k in range(len(rows))]
    many = model.predict(texts)
    assert [o[0][0] for o in one] == many[0] and np.allclose([o[1][0] for o in one], many[1])


def test_long_texts_in_stretches(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    model = language.learn(docs)
    texts = pa.array([r.text for r in docs.collect()] + [None, "", "ä" * 50, "x"])
    want = model.margins(texts)
    for size in (1, 7, 1000):
        monkeypatch.setattr(language, "STRETCH", size)
        assert (model.margins(texts.slice(0, 64 if size > 1 else 3)) == want[: 64 if size > 1 else 3]).all()


@pytest.mark.parametrize("langs", [[], ["en"], ["en", "xx", "yy"]])
def test_few_languages(spark, docs_of, langs):
    texts = {"en": "the cat and the dog", "xx": "zu zu zu va va", "yy": "kok kik kek kuk"}
    rows = [(k, texts[x], x) for k, x in enumerate(langs * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    got = [r.lang_pred for r in language.identify(docs, model).orderBy("doc_id").collect()] if langs else []
    assert got == langs * 6


# ---- toxicity


@pytest.mark.parametrize("sf,recall", [("0.01", 0.8), ("0.1", 0.9)])
def test_toxicity_held_out(spark, sf, recall):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_digest(docs, labels)
    r = got.join(labels, "doc_id").where("held_out").agg(F.sum(((F.col("toxic") == 0) & (F.col("predicted") == 1)).cast("int")), F.sum((F.col("toxic") == 0).cast("int")), F.sum(((F.col("toxic") == 1) & (F.col("predicted") == 1)).cast("int")), F.sum((F.col("toxic") == 1).cast("int"))).first()
    print(sf, tuple(r))
    assert got.count() == docs.count() and r[0] <= 0.02 * r[1] and r[2] >= recall * r[3]


def plain_terms(text):
    words = [w for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if w]
    return Counter(t for w in words for t in [w, *((k, w[:k]) for k in toxicity.BEGINNINGS if len(w) >= k)])


def made_corpus():
    rng = random.Random(12)
    common = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}" for k in range(40)]
    rude = ["grobian", "grobheit", "übeltat", "zzz"]
    rows = []
    for k in range(400):
        text = [rng.choice(common) if rng.random() < 0.6 else f"rare{rng.randrange(3000)}" for _ in range(rng.randrange(5, 60))]
        if k % 3 == 0:
            text += rng.sample(rude, 2)
        rng.shuffle(text)
        rows.append((k, " ".join(text) + "."))
    return rows, [(k, int(k % 3 == 0)) for k in range(0, 400, 2)]


def test_neighbours_by_brute_force(spark, docs_of):
    """The evidence of every row is that of all cosines with all examples, from term counts in plain Python."""
    rows, labels = made_corpus()
    got = toxicity.toxicity(docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    bags = {i: plain_terms(t) for i, t in rows}
    df = Counter(t for b in bags.values() for t in b)
    examples = dict(labels)
    n1 = sum(examples.values())
    n0 = len(examples) - n1
    weight = {}
    for t in {t for i in examples for t in bags[i]}:
        a, b = (sum(t in bags[i] for i, y in examples.items() if y == label) for label in (1, 0))
        share = (a + b) / len(examples)
        error = (share * (1 - share) * (1 / n1 + 1 / n0)) ** 0.5
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        more = max(0.0, odds) if error and (a / n1 - b / n0) / error > toxicity.ERRORS else 0.0
        weight[t] = math.log((2 + len(rows)) / (1 + df[t])) * (1 + toxicity.GAIN * more)
    vectors = {}
    for i, b in bags.items():
        v = {t: (1 + math.log(c)) * weight[t] for t, c in b.items() if t in weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {t: x / norm for t, x in v.items()}
    for r in got:
        own = vectors[r.doc_id]
        sims = {i: sum(x * vectors[i].get(t, 0) for t, x in own.items()) for i in examples}
        want = sorted(sims.values(), reverse=True)[: toxicity.NEIGHBOURS]
        found = [(int(i), float(x)) for i, x in (e.split(":") for e in r.evidence.split())]
        assert np.allclose([x for _, x in found], want, atol=6e-4) and all(abs(sims[i] - x) < 6e-4 for i, x in found)
    right = [(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in got]
    assert sum(right) >= 0.95 * len(right)


def test_block_max_search_leaves_blocks_out(monkeypatch):
    """The search is exact with blocks of any size, and need not look at all of them."""
    rows, labels = made_corpus()
    text = pa.array([t for i, t in rows], pa.large_string())
    toxic = np.array([i % 3 == 0 for i, _ in rows])
    found = toxicity.examples_of(text, list(range(400)), toxic, np.ones(400))
    df = np.bincount(found.term, None, len(found.vocabulary.terms)).astype(float)
    by_size = []
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        by_size.append(toxicity.build_index(found, df, 400).scores(text, 9))
    for scores, evidence in by_size[1:]:
        assert np.allclose(scores, by_size[0][0], atol=1e-3) and evidence == by_size[0][1]


def test_near_copies_are_one_example():
    text = pa.array(["a b c d e f g h i j k l m n", "a b c d e f g h i j k l m o", "a b c d e f g h i j k l m n", "q r s t u v w", None, ""], pa.large_string())
    assert toxicity.unlike(text, np.array([True] * 6)).tolist() == [True, False, False, True, True, True]
    assert toxicity.unlike(text, np.array([True, False, True, True, True, True])).tolist() == [True, True, False, True, True, True]


def test_terms_are_words_and_beginnings():
    terms, bounds = toxicity.terms_of(pa.array(["Übers, ab", None, "", "übersall übers"]))
    a, b = set(terms[bounds[0] : bounds[1]].tolist()), set(terms[bounds[3] : bounds[4]].tolist())
    assert bounds.tolist()[1:3] == [bounds[1]] * 2 and len(a & b) == 2  # the word and its beginning of five letters


def test_toxicity_edges(spark, docs_of):
    rows = [(k, f"some plain words number{k} here") for k in range(40)] + [(100 + k, f"you are a badword person{k} indeed") for k in range(40)] + [(300, None), (301, ""), (302, "new badword text " * 2000), (303, "new plain text"), (None, "badword"), (302, "new badword text " * 2000)]
    labels = spark.createDataFrame([(k, int(k >= 100), 1) for k, _ in rows[:80]] + [(None, 1, 1), (5, None, 1)], "doc_id long, toxic int, quality int")
    got = {}
    for r in toxicity.toxicity(docs_of(rows), labels).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[302][0] >= 0.7 and got[302][0] == got[302][1] and got[None][0] >= 0.7 and max(got[303] + got[3]) < 0.3
    assert got[300] == got[301] == [pytest.approx(0.5, abs=0.02)]  # nothing is known of an empty text but the rate of label 1
    assert toxicity.toxicity(docs_of([]), labels).count() == 0
    only = toxicity.toxicity(docs_of(rows), labels.limit(0)).collect()
    assert len(only) == len(rows) and len({r.score for r in only}) == 1


# ---- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    benchmark = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = columns or docs.columns
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        assert set(after) <= set(before) and all(after[d] == before[d] for d in after)
        if name == "minhash_near_dedup":
            assert near_dup.near_duplicates(docs).where("not kept").count() == 0
        if name == "benchmark_decontamination":
            assert not [d for d, t in after.items() if any(b in t for b in benchmark)]
            assert len(after) >= 0.8 * len(before)
        if name == "language_id":
            assert len(after) >= 0.98 * len(before)


def test_stages_decide_by_row(spark, docs_of, tmp_path):
    """Two unique rows without an id, and an id with two texts of which one is to go: only that row goes, in each stage."""
    plain = [f"p{k}a p{k}b goodword p{k}c p{k}d" for k in range(40)]
    rude = [f"x{k}a x{k}b badword x{k}c x{k}d" for k in range(40)]
    item = "Which river flows through the old town of seven bridges and ends in the northern sea behind the dunes?"
    for name, rows, schema in (
        ("labels", [(k, int(k >= 100), 1) for k in (*range(40), *range(100, 140))], "doc_id long, toxic int, quality int"),
        ("benchmark", [(1, item)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    learned = [(k, t) for k, t in enumerate(plain)] + [(100 + k, t) for k, t in enumerate(rude)]
    one, two, other = ("first lonely sentence of a kind here now", "second lonely sentence of another sort there then", "third thing that an id with two texts also says")

    def after(stage, rows):
        out = stage(spark, docs_of(rows), str(tmp_path))
        assert out.columns == docs_of(rows).columns
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=str)

    unique = [(None, one), (None, two), (500, other)]
    want = sorted(unique, key=str)
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    near = [(1, base), (500, base), (None, base + " and"), (None, one), (3, other + " x y z"), (3, other + " x y z")]
    assert after(corpus_pipeline.near_dup_stage, unique + near) == sorted([*want, (1, base), (3, other + " x y z")], key=str)
    assert len(after(corpus_pipeline.near_dup_stage, [(None, base), (None, base + " and"), *unique])) == 4
    got = after(corpus_pipeline.toxicity_stage, learned + unique + [(500, rude[0]), (None, rude[1])])
    assert [x for x in got if x[0] in (None, 500)] == want
    assert after(corpus_pipeline.decontamination_stage, unique + [(500, "so " + item), (None, "then " + item)]) == want


def test_stages_pass_clashing_columns_through(spark, tmp_path):
    """Columns named as those that the operators make, nulls and repeated rows; an empty table."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.withColumns({c: F.lit(7) for c in ("lang_pred", "lang_score", "row", "score", "component_id", "h", "n", "ids")})
    odd = wide.limit(3).withColumn("text", F.lit(None).cast("string")).unionByName(wide.limit(2)).unionByName(wide.limit(1).withColumn("lang", F.lit(None).cast("string")))
    table = wide.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and out.schema == table.schema, name
        kept = out.collect()
        assert len(kept) > 0.7 * docs.count() and all(r.lang_pred == r.n == 7 for r in kept), name
        assert stage(spark, table.limit(0), SF).count() == 0, name
    assert corpus_pipeline.packing_stage(spark, table, SF).where("length > 0").count() >= table.count()
