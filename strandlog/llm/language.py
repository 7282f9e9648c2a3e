"""Hierarchical language identification: the family first, then one-versus-one linear machines within it.

Features are hashed byte n-grams (2 to 4 bytes of the lower-cased text, anything but letters read as a blank) as relative
frequencies over the whole text. All classifiers are linear support vector machines, so a text's margins are means of one
looked-up weight row per n-gram; nothing is cut off and memory does not grow with a text's features.

The machines are fitted on the driver from a sample of labelled rows whose size is a parameter (``per_language`` distinct
texts of SAMPLE_BYTES at most for each language, dealt by a hash of the text); prediction runs in tasks over all rows.

Defined results: a null text or one without letters is ``und`` with score 0; equal texts get equal results; of languages
with equal votes the first by name wins; texts labelled with several languages teach each of them once; without labelled
rows every text is ``und``; an empty table gives an empty result; texts of any length are looked at whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from strandlog.llm.common import fold, lean, slices, text_bytes

# Families of languages by ISO 639-1 code; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk tr uz",
    "indic": "bn gu hi mr ne pa si ur",
    "semitic": "ar he mt",
}

#: Labelled texts of each language that the machines are fitted on, about; longer texts (in UTF-8 bytes) are not among them.
PER_LANGUAGE, SAMPLE_BYTES = 400, 1 << 16
#: Texts of the sample that are looked at together, to bound the driver's memory.
AT_ONCE = 256
#: Bytes of text whose n-grams are looked up together; longer texts are looked at in stretches.
STRETCH = 1 << 20
#: Hash buckets of the n-grams.
BUCKETS = 1 << 13
_ORDERS = (2, 3, 4)

_LETTER = np.zeros(256, np.uint8)
_LETTER[:] = 32
for _b in (*range(97, 123), *range(128, 256)):
    _LETTER[_b] = _b


def family_of(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def ngrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of each text, by start, shape (bytes, orders), and the texts' bounds; 0: only blanks."""
    return _ngrams(*_lowered(text))


def _lowered(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pc.utf8_lower(text.cast(pa.large_string())))


def _ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = _LETTER[raw].astype(np.uint32)
    # blanks after each text keep its last n-grams apart from the next text's
    spread = np.full(len(x) + 4 * (len(offsets) - 1), 32, np.uint32)
    counts = np.diff(offsets)
    places = np.arange(len(x)) + 4 * np.repeat(np.arange(len(counts)), counts)
    spread[places] = x
    bounds = offsets + 4 * np.arange(len(offsets))
    n = len(spread)
    out = np.empty((n, len(_ORDERS)), np.int32)
    padded = np.concatenate([spread, np.full(4, 32, np.uint32)])
    key = padded[:n].copy()
    for order in range(2, max(_ORDERS) + 1):
        key = key | (padded[order - 1 : order - 1 + n] << np.uint32(8 * (order - 1)))
        if order in _ORDERS:
            h = (key ^ (key >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * order)
            bucket = np.maximum(1, (h >> np.uint32(19)).astype(np.int32) & (BUCKETS - 1))
            out[:, _ORDERS.index(order)] = np.where(key == np.uint32(0x20202020 >> (8 * (4 - order))), 0, bucket)
    between = np.ones(n, bool)
    between[places] = False
    out[between] = 0  # what begins between two texts is of neither
    return out, bounds


@dataclass
class Model:
    """The machines' weight rows by bucket, and which of them decides what."""

    languages: list[str]
    weights: np.ndarray  # (BUCKETS, machines), whole multiples of 1 / unit: sums are exact, in any order
    unit: float
    bias: np.ndarray
    slope: np.ndarray
    families: list[str]
    between: list[tuple[int, int]]  # families of the first machines
    within: list[tuple[int, int]]  # languages of the others

    def _sums(self, grams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum of weight rows, and the number of its n-grams."""
        sums = np.zeros((len(bounds) - 1, len(self.bias)), np.int64)
        counts = np.zeros(len(sums), np.int64)
        for order in range(grams.shape[1]):
            counts += np.add.reduceat(grams[:, order] > 0, bounds[:-1], dtype=np.int64)
            sums += np.add.reduceat(self.weights[grams[:, order]], bounds[:-1], axis=0, dtype=np.int64)
        return sums, counts

    def margins(self, text: pa.Array) -> np.ndarray:
        raw, offsets = _lowered(text)
        if not len(text):
            return np.zeros((0, len(self.bias)))
        if len(raw) <= STRETCH:
            sums, counts = self._sums(*_ngrams(raw, offsets))
        else:
            sums, counts = np.zeros((len(text), len(self.bias)), np.int64), np.zeros(len(text), np.int64)
            for t, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for lo in range(start, stop, STRETCH):  # with the bytes behind it that its last n-grams need
                    part = raw[lo : min(stop, lo + STRETCH + max(_ORDERS) - 1)]
                    n = min(STRETCH, stop - lo)
                    s, c = self._sums(_ngrams(part, np.array([0, len(part)]))[0][:n], np.array([0, n]))
                    sums[t] += s[0]
                    counts[t] += c[0]
        return sums / self.unit / np.maximum(1, counts)[:, None] + self.bias

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and a score from 0 to 1; ``und`` and 0 for a null or a text without letters."""
        p = 1 / (1 + np.exp(-np.clip(self.margins(text) * self.slope, -30, 30))) if len(self.bias) else np.zeros((len(text), 0))
        n, k = len(text), len(self.languages)
        votes, mine = np.zeros((n, len(self.families))), np.array([self.families.index(family_of(x)) for x in self.languages])
        for m, (a, b) in enumerate(self.between):
            votes[:, a] += p[:, m]
            votes[:, b] += 1 - p[:, m]
        votes /= max(1, len(self.families) - 1)
        if len(self.families) == 1:
            votes[:] = 1
        family = votes.argmax(axis=1)
        inner = np.zeros((n, k))
        for m, (a, b) in enumerate(self.within, len(self.between)):
            inner[:, a] += p[:, m]
            inner[:, b] += 1 - p[:, m]
        peers = np.array([max(1, (mine == f).sum() - 1) for f in mine])
        alone = np.array([(mine == f).sum() == 1 for f in mine])
        inner = np.where(alone, 1.0, inner / peers)
        inner[mine[None, :] != family[:, None]] = -1
        best = inner.argmax(axis=1)
        score = votes[np.arange(n), family] * inner[np.arange(n), best]
        letters = np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False))
        langs = [self.languages[b] if has else "und" for b, has in zip(best, letters, strict=True)]
        return langs, np.where(letters, np.clip(score, 0, 1), 0.0)


def _machine(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 40, c: float = 8.0) -> tuple[np.ndarray, float, float]:
    """A linear machine (squared hinge loss, dual coordinate descent) and the slope that makes its margins log-odds.

    It is fitted on the given rows of ``x``, which is not copied; ``squares`` are the rows' squared lengths.
    """
    n = len(y)
    w, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(n)
    cost = c * n / (2.0 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    diagonal = squares[rows] + 1 + 1 / (2 * cost)
    rng = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(n):
            row = x[rows[i]]
            g = y[i] * (row @ w + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - g / diagonal[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += step * row
                bias += step
                moved = max(moved, abs(new - alpha[i]) * diagonal[i])
                alpha[i] = new
        if moved < 1e-2:
            break
    margin, slope = ((x @ w.astype(np.float32))[rows] + bias) * y, 1.0
    for _ in range(50):  # one-parameter logistic regression
        q = 1 / (1 + np.exp(np.clip(slope * margin, -30, 30)))
        slope = float(np.clip(slope + (margin * q).sum() / ((margin**2 * q * (1 - q)).sum() + 1e-3), 0.5, 12))
    return w, float(bias), slope


def fit(texts: pa.Array, langs: list[str]) -> Model:
    """Fit all machines on the given texts."""
    x = np.zeros((len(texts), BUCKETS), np.float32)
    for lo in range(0, len(texts), AT_ONCE):
        grams, bounds = ngrams(texts.slice(lo, AT_ONCE))
        for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), lo):
            x[t] = np.bincount(grams[a:b].ravel(), minlength=BUCKETS)
            x[t, 0] = 0
            x[t] /= max(1, x[t].sum())
    scale = np.zeros(BUCKETS)
    if len(texts):
        scale = 1 / np.sqrt(np.maximum(x.mean(axis=0, dtype=np.float64), 1e-6))  # rare n-grams count as much as frequent ones
        x *= scale.astype(np.float32)
        norm = max(1e-9, float(np.sqrt(np.einsum("ij,ij->i", x, x)).mean()))
        x /= np.float32(norm)
        scale /= norm
    squares = np.einsum("ij,ij->i", x, x).astype(np.float64)
    languages = sorted(set(langs))
    y = np.array([languages.index(z) for z in langs], int)
    families = sorted({family_of(z) for z in languages})
    mine = np.array([families.index(family_of(z)) for z in languages], int)
    between = list(combinations(range(len(families)), 2))
    within = [(a, b) for a, b in combinations(range(len(languages)), 2) if mine[a] == mine[b]]
    machines = []
    for sides, pairs in ((mine[y] if len(y) else y, between), (y, within)):
        for a, b in pairs:
            rows = np.flatnonzero((sides == a) | (sides == b))
            machines.append(_machine(x, squares, rows, np.where(sides[rows] == a, 1.0, -1.0)))
    weights = np.stack([m[0] * scale for m in machines], axis=1) if machines else np.zeros((BUCKETS, 0))
    unit = (1 << 24) / max(1e-12, float(np.abs(weights).max())) if weights.size else 1.0
    return Model(languages, np.ascontiguousarray(np.rint(weights * unit), np.int32), unit, np.array([m[1] for m in machines]), np.array([m[2] for m in machines]), families, between, within)


def training_sample(docs: DataFrame, lang: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """About ``per_language`` distinct texts (text, lang, h) of each language, chosen by a hash of the text."""
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES)).select("text", F.col(lang).alias("lang"), F.xxhash64("text", F.lit(11)).alias("h"))
    counts = {r[0]: r[1] for r in rows.select("lang", "h").distinct().groupBy("lang").count().collect()}  # a line for each language
    u = F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == value) & (u < min(1.0, per_language / n)))
    return rows.where(keep).dropDuplicates(["lang", "h"])


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on a bounded sample of the labelled rows of ``docs`` (text, lang)."""
    sample = training_sample(docs, per_language=per_language).orderBy("h", "lang").toArrow()
    texts = sample.column("text").combine_chunks()
    return fit(texts, sample.column("lang").to_pylist())


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language and its score appended under ``names``; only its column ``text`` is looked at.

    Columns of ``docs`` that have these names already are replaced.
    """
    docs = docs.drop(*names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets by machines
    out = docs.schema.fieldNames()
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                langs, scores = held.value.predict(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*out, *names])

    return docs.mapInArrow(lean(run), schema)


def language_digest(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned from rows whose crc32 fold of 4 is not 2."""
    held_out = fold("doc_id", 4) == 2
    model = learn(docs.where(F.coalesce(~held_out, F.lit(False))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
