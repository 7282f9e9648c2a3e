"""Word-wise encoding, token files and packing against the tokenizers library and exact round trips."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings, strategies as st

from tokenizers import Tokenizer

from strandlog.llm import packing, queries, token_files
from strandlog.llm.tokens import WordTokenizer
from tests.conftest import SF

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a  b", " x", "x ", "a\tb c", "it's we'll 'sx ''s", "a\n\nb", "\n", "é Éa Ö", "<|endoftext|> a", "a b c", "x\x85y z", "a\x1cb c", "日本 語 12,3.4", "a\0b c", "a\r\nb", "İx ǅa straße ẞ", "a.,b c.,", "ab12. 12ab, x's.", "é x", "a. b.\nC d. ..", "x" * 3000]


#: The library as it comes.
PLAIN = {BYTE: Tokenizer.from_file(BYTE), WORD: Tokenizer.from_file(WORD)}


@pytest.fixture(scope="module", params=[(BYTE, True), (WORD, False)])
def own(request):
    made = WordTokenizer(*request.param)
    made.path = request.param[0]
    return made


def same(own, texts):
    want = [np.asarray(e.ids, "<u2").tobytes() for e in PLAIN[own.path].encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert own.encode(texts) == want


def test_odd_texts(own):
    same(own, ODD)
    same(own, ODD)  # from memory


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab'sltm.,!1 \n\téßŁ語́ İ"), max_size=30), max_size=4))
def test_any_text(texts):
    for path, spaced in ((BYTE, True), (WORD, False)):
        key = (path, spaced)
        if key not in _held:
            _held[key] = WordTokenizer(path, spaced)
            _held[key].path = path
        same(_held[key], texts)


_held: dict = {}


def test_forgetting_changes_nothing(own, monkeypatch):
    monkeypatch.setattr("strandlog.llm.tokens.WORDS", 2)
    for k in range(5):
        same(own, [f"word{k} word{k + 1} other, the end.", "the the\nend"])


def test_token_files_round_trip(spark, docs_of, tmp_path):
    rows = [(5, "b c"), (1, "a"), (None, "none"), (3, None), (5, "b c"), (9, "x " * 5000), (2, "")]
    manifest = token_files.write_token_files(docs_of(rows), f"file://{tmp_path}/t", WORD, 1, False)
    got = token_files.read_token_files(manifest).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [1, 2, 3, 5, 5, 9]
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start] == [None, 1, 2, 3, 5, 5, 9]
    at = 0
    for r in by_start:
        text = dict(rows)[r.doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == [*PLAIN[WORD].encode(text or "", add_special_tokens=False).ids, 1] and r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens


def test_reader_seeks_and_checks(tmp_path):
    path = str(tmp_path / "s.zst")
    local = pafs.LocalFileSystem()
    with local.open_output_stream(path, compression=None) as f:
        w = token_files.ShardWriter(f)
        for k in range(2000):
            w.add(k, np.full(300, k, "<u2").tobytes())
        w.finish()
    with local.open_input_file(path) as f:
        r = token_files.ShardReader(f)
        assert r.n_frames > 3
        read: list[int] = []
        whole = r.read
        r.read = lambda k: (read.append(k), whole(k))[1]
        found = r.select({7, 1999})
        assert set(found) == {7, 1999} and np.frombuffer(found[7], "<u2").tolist() == [7] * 300 and len(read) == 2
    import zstandard

    raw = b"".join(zstandard.ZstdDecompressor().read_to_iter(open(path, "rb"), read_size=1 << 16))
    assert len(raw) >= 300 * 2  # any zstandard reader opens it
    data = bytearray(open(path, "rb").read())
    data[20] ^= 255
    open(path, "wb").write(bytes(data))
    with local.open_input_file(path) as f, pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.ShardReader(f).read(0)
    with local.open_output_stream(path, compression=None) as f:
        token_files.ShardWriter(f).finish()
    with local.open_input_file(path) as f:
        assert list(token_files.ShardReader(f).documents()) == []


def check_pieces(pieces, lengths, capacity=1024):
    by_doc: dict = {}
    by_seq: dict = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    for d, n in lengths.items():
        at = 0
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == n and p.length > 0
            at += p.length
        assert at == n
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return by_seq


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").coalesce(1)
    ids = {r.doc_id: [*PLAIN[BYTE].encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    pieces = packing.pack(docs, BYTE, 0).collect()
    by_seq = check_pieces(pieces, {d: len(x) for d, x in ids.items()})
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length]
    used = sum(map(len, ids.values()))
    assert len(by_seq) * 1024 <= used * 1.02  # little padding


def test_packing_edges(spark, docs_of):
    assert packing.pack(docs_of([]), BYTE, 0).count() == 0
    got = packing.pack(docs_of([(1, None), (2, ""), (None, "a")]).coalesce(1), BYTE, 0).collect()
    assert sorted((r.doc_tokens, r.length) for r in got) == [(1, 1), (1, 1), (2, 2)] and len({r.sequence_id for r in got}) == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_differencing(sizes):
    where, k = packing.pack_block(sizes, 64)
    sums = np.bincount(where, sizes, k)
    assert sums.max() <= 64 and len(where) == len(sizes)
    two = np.bincount(packing.differencing(sizes, 2), sizes, 2)
    greedy = [0, 0]
    for s in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += s
    assert abs(two[0] - two[1]) <= max(sizes)


def test_differencing_is_near_equal():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 600).tolist()
    sums = np.bincount(packing.differencing(sizes, 75), sizes, 75)
    assert sums.max() - sums.min() <= 16


SPECIAL = ["<|endoftext|> hi", "plain words, and <|startoftext|> inside", None, "", "same text", "same text", "many " * 3000, "a\u00a0b\tc"]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_queries_equal_the_plain_library(spark, tmp_path):
    """op9 and op10 as registered, over texts that hold special strings, against the library as it comes."""
    rows = [(100 - k, x) for k, x in enumerate(SPECIAL)] + [(200, "same text"), (200, "same text")]
    spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    start, want = 0, []
    for i, x in sorted(rows, key=lambda r: r[0]):
        ids = [*PLAIN[WORD].encode(x or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = queries.op9_token_files(spark, str(tmp_path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    ids = {i: [*PLAIN[BYTE].encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    pieces = queries.op10_packing(spark, str(tmp_path)).collect()
    check_pieces(pieces, {i: len(x) for i, x in ids.items() if i != 200})
    assert all(p.ids_crc32 == crc(ids[p.doc_id][p.start : p.start + p.length]) for p in pieces)
    assert sorted((p.start, p.length) for p in pieces if p.doc_id == 200) == [(0, len(ids[200]))] * 2
    assert ids[100][0] == 50256 and len({p.doc_id for p in pieces}) == len(ids)
