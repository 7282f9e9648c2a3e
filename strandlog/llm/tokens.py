"""Documents to token ids with a public tokenizer, at the speed of a dictionary look-up.

Both tokenizers split a text before their merges in a way that no piece crosses from a visible character into the white
space behind it, so every word can be encoded by itself. A word of Latin letters (and ``.`` or ``,`` behind it) is one
piece, which the library's model merges once for as long as a Python worker remembers it; other words go through the whole
library. Ids are kept as little-endian bytes, and a text is a join of bytes. A text with other white space than single
blanks and newlines, or with a special string of the vocabulary in it (whose own id the library gives), goes to the
tokenizer whole.
"""

from __future__ import annotations

import os
import re
from array import array

from tokenizers import Tokenizer

#: Distinct words that a worker remembers, about; bounds its memory, not the result.
WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """A printable character for each byte value: itself where Latin-1 shows one, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


class WordTokenizer:
    """Encodes texts to ids (little-endian unsigned 16-bit integers) with a tokenizers JSON file, as the library does.

    ``spaced``: the blank before a word belongs to its ids (byte-level vocabularies); else white space is dropped.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.spaced = spaced
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.heads = {x for t in added for x in (t[0].lower(), t[0].upper())}
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I).search
        self.merge = self.tokenizer.model.tokenize
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.inner: dict[str, bytes] = {}  # words behind a blank
        self.first: dict[str, bytes] = {}  # words that begin a line
        self.signs: dict[str, bytes] = {}  # what stands behind a word

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _sign(self, sign: str) -> bytes:
        if sign not in self.signs:
            if len(self.signs) > 1000:
                self.signs = {}
            self.signs[sign] = self._encode([sign])[0]
        return self.signs[sign]

    def _learn(self, words: set[str], known: dict[str, bytes], blank: str) -> dict[str, bytes]:
        """The ids of ``words``; ``known`` learns of their letters, and forgets all once it knows too much."""
        merge, letters, spaced, now, other = self.merge, self.letters, self.spaced, {}, []
        if len(known) > WORDS:
            known.clear()
        for w in words:
            core = w.rstrip(".,")
            ids = known.get(core)
            if ids is None:
                if not (core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core)):
                    other.append(w)
                    continue
                piece = blank + (core if spaced else core.lower())
                shown = piece.encode().decode("latin-1").translate(letters) if blank or not core.isascii() else piece
                ids = known[core] = array("H", [t.id for t in merge(shown)]).tobytes()
            now[w] = ids if len(core) == len(w) else ids + self._sign(w[len(core) :])
        now.update(zip(other, self._encode([blank + w for w in other]), strict=True))
        return now

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null is an empty text."""
        out: list[bytes] = [b""] * len(texts)
        plain: list[tuple[int, list[str]]] = []
        for i, x in enumerate(texts):
            if not x:
                continue
            words = x.split()
            if x.count(" ") + x.count("\n") == len(words) - 1 == len(x) - sum(map(len, words)) and not (any(h in x for h in self.heads) and self.special(x)):
                plain.append((i, words))
            else:  # one by one: any of them may be very long
                out[i] = self._encode([x])[0]
        now = self._learn(set().union(*(words for _, words in plain)), self.inner, " " if self.spaced else "")
        get = now.__getitem__
        if not self.spaced:
            for i, words in plain:
                out[i] = b"".join(map(get, words))
            return out
        # words that begin a line have no blank before them; places are counted in words
        lines = []
        for i, words in plain:
            starts = [0]
            for line in texts[i].split("\n")[:-1]:
                starts.append(starts[-1] + line.count(" ") + 1)
            lines.append((i, words, starts))
        begin = self._learn({words[at] for _, words, starts in lines for at in starts}, self.first, "")
        newline = self._encode(["\n"])[0]
        for i, words, starts in lines:
            ids = list(map(get, words))
            for at in starts:
                ids[at] = newline + begin[words[at]] if at else begin[words[at]]
            out[i] = b"".join(ids)
        return out


_HELD: dict[tuple, WordTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> WordTokenizer:
    """The worker's own tokenizer; a worker that Spark uses again keeps the last one and what it has learned."""
    key = (path, spaced)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = WordTokenizer(*key)
    return _HELD[key]
