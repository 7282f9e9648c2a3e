"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes.

Terms are lower-cased words and word beginnings (five letters, for inflected and compounded languages). The vocabulary is
every term of the labelled examples, which are a bounded, documented sample of the labelled rows; document frequencies come
from all rows of the corpus. A term's weight is (1 + log tf) * idf, and more for terms that label 1 makes likelier, by
their log-odds in the sample; no term is dropped.

The examples are kept as inverted lists cut into blocks of BLOCK examples; for each term and block that it occurs in, the
largest weight is known. Lists of terms that one example in DENSE has are kept as rows of numbers, since few places in them
are empty. A text's examples are found block by block in the order of the blocks' upper bounds, until no bound exceeds the
k-th best cosine: the result is the exact top k. Weights are whole multiples of UNIT, so that sums are exact in any order. The score is the share of toxic examples among them, each
weighted by its squared cosine and by how many labelled rows it stands for, and drawn to the rate of label 1 as far as they
are distant; a logistic curve fitted on left-one-out scores of the examples turns it into a probability.

Defined results: a null text is empty; texts without terms of the vocabulary get the rate of label 1; equal texts get equal
scores; of examples with equal cosines the first in the index (by hash) counts; labelled rows that repeat a text are one
example for each label; without labels of both kinds every score is the rate of label 1; a doc_id labelled twice has its
larger label; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandlog.llm import shingles as sh
from strandlog.llm.common import Scratch, fold, lean, row_key, slices, text_bytes

#: Labelled examples of each label, about; the sample is dealt by a hash of the text.
EXAMPLES = 1500
#: Longer texts (in UTF-8 bytes) are no examples, which bounds the sample's memory.
EXAMPLE_BYTES = 1 << 16
BEGINNINGS = (5,)
BLOCK, NEIGHBOURS = 64, 9
#: A term in one of so many examples has its list as a row of numbers.
DENSE = 16
UNIT = 2.0**-20
#: A term whose frequencies under the two labels differ by this many standard errors weighs GAIN times its log-odds more.
ERRORS, GAIN = 4.0, 3.0
#: Squared cosines (summed over the neighbours) at which their votes count half.
DOUBT = 0.5
#: Texts of the sample that are looked at together, to bound the driver's memory.
AT_ONCE = 128

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]] = True


def terms_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words and word beginnings, and the texts' bounds; ASCII punctuation parts words."""
    raw, offsets = text_bytes(pc.utf8_lower(text.cast(pa.large_string())))
    raw = np.where(_PUNCTUATION[raw], np.uint8(32), raw)
    n, n_texts = len(raw), len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    word = raw != 32
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    begins[edges] = word[edges]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | begins[1:]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = sh.word_sums(raw, word, begins)
    # where the k-th letter of a word ends: continuation bytes belong to the letter before them
    lead = np.concatenate([np.cumsum((raw & 0xC0) != 0x80), [np.iinfo(np.int64).max]])
    columns, keep = [sh.mix(sums[stops] - sums[starts])], [np.ones(len(starts), bool)]
    letter_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), n)
    first = lead[starts] - 1  # index of the word's first letter
    for k in BEGINNINGS:
        stop = letter_at[np.minimum(first + k, len(letter_at) - 1)]
        inside = stop <= stops
        stop = np.where(inside, stop, stops)
        columns.append(sh.mix(sums[stop] - sums[starts] + np.uint64(k)))
        keep.append(inside)
    flat, valid = np.stack(columns, axis=1).ravel(), np.stack(keep, axis=1).ravel()
    bounds = np.searchsorted(starts, offsets) * len(columns)
    kept = np.concatenate([[0], np.cumsum(valid)])
    return flat[valid], kept[bounds]


def bags(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term hash, count) of all distinct terms of each text, by text and hash; arrays of equal length."""
    terms, bounds = terms_of(text)
    which = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((terms, which))
    which, terms = which[order], terms[order]
    new = np.ones(len(terms), bool)
    new[1:] = (terms[1:] != terms[:-1]) | (which[1:] != which[:-1])
    at = np.flatnonzero(new)
    return which[at], terms[at], np.diff(np.append(at, len(terms)))


def unlike(text: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Marks one text of each group of near copies under the same label (four fifths of their 3-word shingles in common).

    A term counts for as many examples as were written, not for as many copies as were made of one.
    """
    kept: dict[tuple[int, bool], list[np.ndarray]] = {}
    out = np.ones(len(text), bool)
    for lo in range(0, len(text), AT_ONCE):
        sets, bounds = sh.shingle_sets(*text_bytes(text.slice(lo, AT_ONCE)), 3)
        keys = sh.band_keys(sh.similarity_sketches(sets, bounds, 64), 4)
        for t in range(len(bounds) - 1):
            own = sets[bounds[t] : bounds[t + 1]].copy()
            if not len(own):
                continue
            places = [(k, bool(toxic[lo + t])) for k in keys[t].tolist()]
            for other in {id(x): x for p in places for x in kept.get(p, ())}.values():
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 5 * both >= 4 * (len(own) + len(other) - both):
                    out[lo + t] = False
                    break
            else:
                for p in places:
                    kept.setdefault(p, []).append(own)
    return out


class Vocabulary:
    """Sorted term hashes, and how to find terms among them."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(terms >> np.uint64(44)).astype(np.int64)] = True

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``terms`` are known, and their numbers."""
        hit = np.flatnonzero(self.maybe[(terms >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, terms[hit]), max(0, len(self.terms) - 1))
        good = self.terms[at] == terms[hit] if len(self.terms) else np.zeros(0, bool)
        return hit[good], at[good]

    def counts(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term number, count) of the known terms of each text, by text and term; arrays of equal length."""
        terms, bounds = terms_of(text)
        hit, number = self.find(terms)
        key = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[hit] * max(1, len(self.terms)) + number
        key, count = np.unique(key, return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), count


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@dataclass
class Index:
    """The labelled examples' inverted lists, cut into blocks of examples, and the votes' calibration.

    List t has the entries first[t] to first[t + 1], one for each block that the term occurs in; entry e has the postings
    posting[e] to posting[e + 1]. The list of a frequent term is the row ``row`` of ``dense`` instead.
    """

    vocabulary: Vocabulary
    weight: np.ndarray  # of each term
    first: np.ndarray
    block: np.ndarray  # of each entry
    most: np.ndarray  # each entry's largest weight
    posting: np.ndarray
    example: np.ndarray  # of each posting
    value: np.ndarray
    row: np.ndarray  # of each term, -1 for those with entries
    dense: np.ndarray  # (frequent terms, examples)
    toxic: np.ndarray
    stands_for: np.ndarray
    doc_ids: np.ndarray
    curve: tuple[float, float]
    silent: float  # score of a text without known terms

    def weights(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.weight[term]
        return np.rint(w / max(1e-12, float(np.sqrt((w**2).sum()))) / UNIT) * UNIT

    def nearest(self, at: np.ndarray, term: np.ndarray, count: np.ndarray, k: int, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text (its terms stand from at[i] to at[i + 1]) the k examples of highest cosine, and their cosines.

        Ties: first in the index; examples of cosine 0 are left out, and text i's example without[i].
        """
        n = len(at) - 1
        w = np.concatenate([self.weights(term[a:b], count[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]) if n else np.zeros(0)
        row = self.row[term]
        frequent = row >= 0
        table = np.zeros((n, len(self.dense)))
        table[np.repeat(np.arange(n), np.diff(at))[frequent], row[frequent]] = w[frequent]
        known = table @ self.dense
        blocks = np.arange(0, len(self.toxic), BLOCK)
        out = []
        for i in range(n):
            own = slice(at[i], at[i + 1])
            rare = ~frequent[own]
            skip = -1 if without is None else without[i]
            out.append(self._best(known[i], np.maximum.reduceat(known[i], blocks), term[own][rare], w[own][rare], k, skip))
        return out

    def _best(self, known: np.ndarray, bound: np.ndarray, term: np.ndarray, w: np.ndarray, k: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """nearest() of one text: ``known`` are the examples' sums over its frequent terms, ``term`` and ``w`` the others."""
        sizes = self.first[term + 1] - self.first[term]
        entries = _ranges(self.first[term], sizes)
        of, block = np.repeat(w, sizes), self.block[entries]
        bound = bound + np.bincount(block, of * self.most[entries], len(bound))
        order = np.argsort(-bound, kind="stable")
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        at, step = 0, 4
        while at < len(order) and bound[order[at]] > 0 and (len(sims) < k or bound[order[at]] >= sims[k - 1]):
            chosen = order[at : at + step]
            at, step = at + step, 4 * step
            wanted = np.zeros(len(order), bool)
            wanted[chosen] = True
            own = np.flatnonzero(wanted[block])
            e = entries[own]
            sizes = self.posting[e + 1] - self.posting[e]
            postings = _ranges(self.posting[e], sizes)
            s = known + np.bincount(self.example[postings], np.repeat(of[own], sizes) * self.value[postings], len(known))
            inside = (np.sort(chosen)[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            inside = inside[inside < len(known)]
            good = inside[(s[inside] > 0) & (inside != skip)]
            ids, sims = np.concatenate([ids, good]), np.concatenate([sims, s[good]])
            top = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[top], sims[top]
        return ids, sims

    def vote(self, ids: np.ndarray, sims: np.ndarray) -> float:
        """The neighbours' weighted share of label 1, drawn to the silent score as far as they are distant."""
        near = float((sims**2).sum())
        w = sims**2 * self.stands_for[ids]
        share = float((w * self.toxic[ids]).sum() / max(1e-12, w.sum()))
        return (near * share + DOUBT * self.silent) / (near + DOUBT)

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a * (2 * vote - 1) + b, -30, 30))))

    def scores(self, text: pa.Array, k: int) -> tuple[list[float], list[str]]:
        """The score and the evidence (doc ids and cosines) of each text."""
        which, term, counts = self.vocabulary.counts(text)
        at = np.searchsorted(which, np.arange(len(text) + 1))
        scores, evidence = [], []
        for ids, sims in self.nearest(at, term, counts, k):
            scores.append(self.calibrated(self.vote(ids, sims)) if len(ids) else self.silent)
            evidence.append(" ".join(f"{self.doc_ids[i]}:{x:.3f}" for i, x in zip(ids.tolist(), sims.tolist(), strict=True)))
        return scores, evidence


@dataclass
class Examples:
    """The labelled examples as bags of terms: rows (example, term number, count) by example."""

    vocabulary: Vocabulary
    example: np.ndarray
    term: np.ndarray
    count: np.ndarray
    toxic: np.ndarray
    stands_for: np.ndarray
    doc_ids: np.ndarray


def examples_of(text: pa.Array, doc_ids: list, toxic: np.ndarray, stands_for: np.ndarray) -> Examples:
    found = [(lo, *bags(text.slice(lo, AT_ONCE))) for lo in range(0, len(text), AT_ONCE)]
    hashes = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint64)
    terms, term = np.unique(hashes, return_inverse=True)
    example = np.concatenate([lo + which for lo, which, _, _ in found]) if found else np.zeros(0, np.int64)
    count = np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.int64)
    return Examples(Vocabulary(terms), example, term, count, toxic, stands_for, np.array([-1 if x is None else x for x in doc_ids], np.int64))


def build_index(x: Examples, df: np.ndarray, n_docs: int, k: int = NEIGHBOURS) -> Index:
    """Index the labelled examples; ``df``: in how many of all ``n_docs`` rows each term occurs."""
    n, n_terms = len(x.toxic), len(x.vocabulary.terms)
    n1, n0 = float(x.toxic.sum()), float((~x.toxic).sum())
    in1 = np.bincount(x.term, x.toxic[x.example].astype(float), n_terms)
    in0 = np.bincount(x.term, None, n_terms) - in1
    share = (in1 + in0) / max(1, n)
    errors = (in1 / max(1, n1) - in0 / max(1, n0)) / np.sqrt(np.maximum(1e-12, share * (1 - share) * (1 / max(1, n1) + 1 / max(1, n0))))
    odds = np.log((in1 + 0.5) / (n1 + 1)) - np.log((in0 + 0.5) / (n0 + 1))
    weight = np.log((2 + n_docs) / (1 + df)) * (1 + GAIN * np.where(errors > ERRORS, np.maximum(0, odds), 0))
    value = (1 + np.log(x.count)) * weight[x.term]
    value /= np.sqrt(np.maximum(1e-12, np.bincount(x.example, value**2, n)))[x.example]
    value = np.rint(value / UNIT) * UNIT

    # examples of one label whose heaviest terms are the same are neighbours in the index, which makes bounds tight
    by = np.lexsort((value, x.example))
    last = np.flatnonzero(np.append(x.example[by][1:] != x.example[by][:-1], True)) if len(by) else by
    heaviest = np.full(n, -1)
    heaviest[x.example[by][last]] = x.term[by][last]
    order = np.lexsort((np.arange(n), heaviest, ~x.toxic))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    example = place[x.example]
    frequent = np.flatnonzero((in1 + in0) * DENSE > n)
    row = np.full(n_terms, -1, np.int32)
    row[frequent] = np.arange(len(frequent))
    own = row[x.term] >= 0
    dense = np.zeros((len(frequent), n))
    dense[row[x.term[own]], example[own]] = value[own]
    by = np.lexsort((example, x.term))
    by = by[~own[by]]
    term, example, value = x.term[by], example[by], value[by]
    new = np.ones(len(by), bool)
    new[1:] = (term[1:] != term[:-1]) | (example[1:] // BLOCK != example[:-1] // BLOCK)
    at = np.flatnonzero(new)
    most = np.maximum.reduceat(value, at) if len(at) else np.zeros(0)
    rate = float((x.stands_for * x.toxic).sum() + 0.5) / float(x.stands_for.sum() + 1)
    index = Index(
        x.vocabulary, weight, np.searchsorted(term[at], np.arange(n_terms + 1)).astype(np.int32), (example[at] // BLOCK).astype(np.int32), most.astype(np.float32),
        np.append(at, len(by)).astype(np.int32), example.astype(np.int32), value.astype(np.float32), row, dense, x.toxic[order], x.stands_for[order], x.doc_ids[order], (4.0, 0.0), rate,
    )
    votes, labels, w = [], [], []
    starts = np.searchsorted(x.example, np.arange(n + 1))
    for lo in range(0, n, AT_ONCE):
        at = starts[lo : lo + AT_ONCE + 1]
        own = slice(at[0], at[-1])
        for i, (ids, sims) in enumerate(index.nearest(at - at[0], x.term[own], x.count[own], k, place[lo : lo + AT_ONCE]), lo):
            if len(ids):
                votes.append(2 * index.vote(ids, sims) - 1)
                labels.append(float(x.toxic[i]))
                w.append(x.stands_for[i])
    index.curve = _logistic(np.array(votes), np.array(labels), np.array(w))
    return index


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic regression, held near (4, 0) by a weak prior."""
    a, b = 4.0, 0.0
    if not len(x):
        return a, b
    w = w / w.mean()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((y - p) * x * w).sum() - 0.1 * (a - 4), ((y - p) * w).sum() - 0.1 * b])
        v = p * (1 - p) * w
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -1, 1)
    return float(a), float(b)


def labelled_sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, examples: int = EXAMPLES) -> DataFrame:
    """About ``examples`` texts of each label (doc_id, text, toxic, stands_for): a sample by hash among distinct texts."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    short = docs.where(F.octet_length("text") <= EXAMPLE_BYTES).select("doc_id", F.xxhash64("text").alias("h"))
    texts = scratch.cut(short.join(known, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")), "labelled-texts")
    counts = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}  # a line for each label
    u = F.pmod(F.xxhash64("h", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep, stands = F.lit(False), F.lit(1.0)
    for value, n in sorted(counts.items()):
        rate = min(1.0, examples / n)
        keep = keep | ((F.col("toxic") == value) & (u < rate))
        stands = F.when(F.col("toxic") == value, F.lit(1 / rate)).otherwise(stands)
    chosen = F.broadcast(texts.where(keep).withColumn("stands_for", stands))  # about twice ``examples`` rows
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(chosen, ["doc_id", "h"])
    return own.dropDuplicates(["doc_id", "h", "toxic"])


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, evidence (doc ids of the nearest examples with their cosines) for every row of ``docs``.

    ``labels`` (doc_id, toxic): only these rows are learned from. An example's own text may be its evidence.
    """
    return row_scores(docs, labels, examples, k).select("doc_id", "score", "evidence")


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> Index:
    """The index of the labelled examples among ``docs``, with document frequencies over all of ``docs``."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = labelled_sample(docs, labels, scratch, examples).orderBy(F.xxhash64("h"), "doc_id", "toxic").toArrow()
    text = sample.column("text").combine_chunks().cast(pa.large_string()) if sample.num_rows else pa.array([], pa.large_string())
    toxic = np.array(sample.column("toxic").to_pylist(), dtype=bool)
    own = unlike(text, toxic)
    chosen = sample.filter(pa.array(own, pa.bool_()))
    found = examples_of(text.filter(pa.array(own, pa.bool_())), chosen.column("doc_id").to_pylist(), toxic[own], np.array(chosen.column("stands_for").to_pylist(), dtype=float))
    held = spark.sparkContext.broadcast(found.vocabulary)  # the terms of a bounded sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(len(held.value.terms), np.int64)
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                n += part.num_rows
                df += np.bincount(held.value.counts(part.column("text"))[1], None, len(df))
        terms = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(terms, -1), pa.int32()), pa.array(np.append(df[terms], n))], names=["term", "n"])

    counted = docs.select("text").mapInArrow(lean(count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a line for each term
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    df = np.zeros(len(found.vocabulary.terms))
    df[term[term >= 0]] = n[term >= 0]
    return build_index(found, df, int(n[term < 0].sum()), k)


def row_scores(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, k: int = NEIGHBOURS) -> DataFrame:
    """toxicity() with each row's row_key() as ``row``."""
    index = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, examples, k))  # of a bounded sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                scores, evidence = index.value.scores(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, pa.string()), part.column("row")], names=["doc_id", "score", "evidence", "row"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row"))
    return rows.mapInArrow(lean(score), "doc_id long, score double, evidence string, row long")


def learnable(labels: DataFrame) -> DataFrame:
    """The rows of ``labels`` whose crc32 fold of 3 is not 1."""
    return labels.where(fold("doc_id", 3) != 1)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence of every row; learned from labels whose crc32 fold of 3 is not 1."""
    out = toxicity(docs, learnable(labels))
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")
