"""Main text of web pages: a suffix array over each host's pages says what is boilerplate, page structure weighs it.

1. Every page is parsed once (leniently: unclosed and stray tags, cut-off pages) into blocks. A block is *prose* (a
   paragraph, heading, list item, cell or quotation inside the page's article or main element), *furniture* (inside
   navigation, headers, footers, asides, forms, or an element whose class, id or role names an advert, notice, comments and
   so on) or *open*.
2. The token streams of a host's distinct pages are concatenated, suffixes are sorted by prefix doubling, and the
   substrings of MIN_TOKENS tokens or more that stand on MIN_PAGES distinct pages of the host are found. Blocks that they
   cover are removed, unless they are prose: an article's own paragraphs stay, even if other pages quote them.
3. What is left unique is weighed by structure: furniture that no other page repeats (reader comments, a notice of this
   page) goes, open blocks stay; on a page that has an article or main element, open blocks outside of it go too. If
   nothing would be left, the page keeps its open blocks.

Substrings that lie in prose alone can decide nothing, so of a run of prose only the MIN_TOKENS - 1 tokens next to other
blocks enter the array; every other token does. A host's pages are dealt into blocks of about BLOCK_TOKENS tokens by a hash
of their streams, each with a suffix array of its own. Its groups of equal suffixes go out as (host, hash of the
MIN_TOKENS tokens, number of distinct pages), are summed over the host's blocks, and those that reach MIN_PAGES come back
to mark what they cover. So the number of blocks changes no result, and no task holds a whole host. Equal streams meet in
one block and count once; a task sends each of its equal streams once.

Defined results: a null html has an empty text; repeated rows give repeated results; a url without a host belongs to the
host ''; equal pages of a host are one page; other columns are ignored; pages of any length are parsed whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from strandlog.llm import shingles as sh
from strandlog.llm.common import BROADCAST_ROWS, Scratch, lean, slices, text_bytes

MIN_TOKENS, MIN_PAGES = 8, 3
#: A block is covered if this share of its tokens is.
COVERED = 0.8
#: Tokens of a host that one suffix array takes, about.
BLOCK_TOKENS = 20_000
#: Pages with covered blocks (about 250 bytes each) up to which these are broadcast to the pages; beyond, both are shuffled.
COVERED_ROWS = 100_000
#: Parts in which a host's pages meet the host's totals, if there are too many large hosts to broadcast.
SALTS = 16

# Elements of HTML by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption summary".split())
SPACED = set("br td th wbr img input".split()) - {"wbr"}
FURNITURE = set("nav footer aside form button select dialog menu search datalist map".split())
MAIN = {"article", "main"}
WORDS = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus donate footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promos promotion recirc recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets".split())
#: Words that say nothing of what an element is; a class of such words and one of WORDS is furniture ("comments-area").
LAYOUT = set("area bar block body bottom box btn button buttons card cell col column container content cta fixed float group head header holder icon id inline inner item items js left link links list message module outer page panel policy post posts primary right row secondary section site slot small sticky text title top unit ui view zone".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|noscript|template|iframe|svg|math|object|audio|video|canvas|textarea|title|head)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>|<[!?/][^>]*+>|<[a-zA-Z!?/][^>]*+\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _role(name: str, attributes: str, in_main: bool) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the page's main element."""
    if name in FURNITURE or (name == "header" and not in_main):
        return True, False
    if not attributes or attributes.isspace():
        return False, name in MAIN
    given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in given or given.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True, False
    role = given.get("role", "").lower()
    if name in MAIN or role in ("main", "article") or given.get("itemprop") == "articleBody":
        return False, True
    if role in ROLES:
        return True, False
    if name in ("html", "body") or name in PROSE and name[0] == "h":
        return False, False
    for named in f"{given.get('class', '')} {given.get('id', '')}".split():
        words = {w.lower() for w in _WORD.findall(named)}
        if words & WORDS and words <= WORDS | LAYOUT or not in_main and words == {"header"}:
            return True, False
    return False, False


def parse(page: str | None) -> tuple[list[str], list[str], bool]:
    """The blocks of a page in order, a kind for each (p prose, f furniture, o open), and whether it has a main element.

    Kind m is an open block inside the main element. A form that the main element lies in is the page's frame, not furniture.
    """
    texts: list[str] = []
    kinds: list[str] = []
    stack: list[tuple[str, int, bool, int]] = []
    parts: list[str] = []
    furniture = main = prose = 0
    forms = 0  # open forms since the last main element
    any_main = False

    def flush() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                texts.append(text)
                kinds.append("f" if furniture or forms else ("p" if prose else "m") if main else "o")
            parts.clear()

    def pop() -> None:
        nonlocal furniture, main, prose, forms
        name, was_furniture, was_main, forms = stack.pop()
        furniture -= was_furniture
        main -= was_main
        prose -= name in PROSE

    at = 0
    page = page or ""
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name in SPACED:
            parts.append(" ")
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    while len(stack) > depth:
                        pop()
                    break
        elif name not in VOID and not attributes.endswith("/"):
            if name in ("p", "li", "dd", "dt") and stack:  # an open one ends where the next begins
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        while len(stack) > depth:
                            pop()
                        break
                    if stack[depth][0] in ("div", "section", "article", "main", "ul", "ol", "dl", "td", "blockquote", "aside", "nav", "form", "footer", "header"):
                        break
            is_furniture, is_main = _role(name, attributes, main > 0)
            stack.append((name, int(is_furniture and name != "form"), is_main, forms))
            furniture += stack[-1][1]
            forms = 0 if is_main else forms + (name == "form")
            main += is_main
            prose += name in PROSE
            any_main |= is_main and not furniture
    if at < len(page):
        parts.append(page[at:])
    flush()
    return texts, kinds, any_main


def streams_of(texts: list[str], kinds: list[str], reach: int = MIN_TOKENS - 1) -> tuple[list[str], list[int]]:
    """What of a page enters the suffix array: blocks that aren't prose with their numbers, and the prose next to them.

    Such prose has the number -1; where prose is left out the stream breaks ("", -2).
    """
    out, numbers = [], []
    last = -1  # block before the run of prose
    for i in [*(k for k, kind in enumerate(kinds) if kind != "p"), len(kinds)]:
        run = texts[last + 1 : i]
        before = last >= 0
        after = i < len(kinds)
        if run and (before or after):
            head: list[str] = []
            for t in run:
                head += t.split(" ", reach + 1 - len(head))[: reach + 1 - len(head)]
                if len(head) > reach:
                    break
            if len(head) <= reach:
                out.append(" ".join(head))
                numbers.append(-1)
            else:
                tail: list[str] = []
                for t in reversed(run):
                    tail[:0] = t.rsplit(" ", reach - len(tail))[-(reach - len(tail)) :]
                    if len(tail) >= reach:
                        break
                out += [" ".join(head[:reach]) if before else "", "", " ".join(tail) if after else ""]
                numbers += [-1, -2, -1]
        if after:
            out.append(texts[i])
            numbers.append(i)
        last = i
    return out, numbers


PARSED = "page_id long, url string, host string, sid long, texts array<string>, kinds string, places array<int>, main boolean, n_blocks int, stream array<string>, numbers array<int>, n_tokens long"
HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)"


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row per page: its blocks without furniture (texts, kinds, places), and its stream with the stream's hash.

    ``stream`` is null where the task has sent an equal stream of the host before.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    keyed = pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), F.col("html").alias("text"))
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("sid", pa.int64()), ("texts", pa.list_(pa.string())), ("kinds", pa.string()), ("places", pa.list_(pa.int32())), ("main", pa.bool_()), ("n_blocks", pa.int32()), ("stream", pa.list_(pa.string())), ("numbers", pa.list_(pa.int32())), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()

        def row_of(page: str | None, host: str) -> tuple:
            texts, kinds, main = parse(page)
            stream, numbers = streams_of(texts, kinds)
            sid = xxhash.xxh64_intdigest("\0".join((host, *stream, *map(str, numbers)))) - (1 << 63)
            n = sum(t.count(" ") + 1 for t in stream if t)
            new = n > 0 and sid not in sent
            sent.add(sid)
            places = [i for i, k in enumerate(kinds) if k != "f"]
            return sid, [texts[i] for i in places], "".join(kinds).replace("f", ""), places, main, len(kinds), stream if new else None, numbers if new else None, n if new else 0

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                found = zip(*map(row_of, part.column("text").to_pylist(), part.column("host").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, f.type) for c, f in zip(found, list(schema)[3:], strict=True))], schema=schema)

    return keyed.mapInArrow(lean(run), PARSED)


def suffix_ranks(tokens: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The suffix array of a token stream by prefix doubling, to ``depth`` tokens, as the rank of every suffix.

    ``left``: tokens to the end of each suffix's stretch. Suffixes that have ``depth`` tokens left are of equal rank if and
    only if those tokens are equal.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    reached = 1
    while reached < depth:
        step = min(reached, depth - reached)  # overlapping the halves reaches any depth
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:]
        second[left <= step] = -np.arange(1, n + 1)[left <= step]  # a suffix that ends is like no other
        order = np.lexsort((second, rank))
        fresh = np.ones(n, np.int64)
        fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(fresh)
        rank = new
        reached += step
    return rank


class _Stretches:
    """The streams of one block of a host's pages, laid out one after another; rows of equal ``sid`` are one."""

    def __init__(self, table: pa.Table):
        self.sids, first = np.unique(table.column("sid").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        stream, numbers = (table.column(c).combine_chunks() for c in ("stream", "numbers"))
        row = np.repeat(np.arange(len(first)), np.asarray(stream.value_lengths()))
        self.numbers = numbers.flatten().to_numpy()
        self.words, self.counts = sh.word_hashes(*text_bytes(stream.flatten()))
        begins = np.ones(len(row), bool)
        begins[1:] = row[1:] != row[:-1]
        stretch = np.repeat(np.cumsum(begins | (self.numbers == -2)), self.counts)
        self.row, self.page = row, np.repeat(row, self.counts)
        ends = np.append(np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, len(stretch))
        self.left = ends[np.searchsorted(ends, np.arange(len(stretch)), "right")] - np.arange(len(stretch)) if len(stretch) else np.zeros(0, np.int64)
        self.starts = np.flatnonzero(self.left >= MIN_TOKENS)

    def hashes(self, starts: np.ndarray) -> np.ndarray:
        """A hash of the MIN_TOKENS tokens from each start, the same in every block."""
        return sh.mix(sum(self.words[starts + j] * sh._PLACE[j] for j in range(MIN_TOKENS))).view(np.int64) if len(starts) else np.zeros(0, np.int64)

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Each group of suffixes with MIN_TOKENS equal tokens: its hash, and on how many pages it stands."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = suffix_ranks(self.words, self.left, MIN_TOKENS)[self.starts]
        order = np.lexsort((self.page[self.starts], rank))
        rank, page, at = rank[order], self.page[self.starts][order], self.starts[order]
        group = np.append(True, rank[1:] != rank[:-1])
        new_page = group | np.append(True, page[1:] != page[:-1])
        heads = np.flatnonzero(group)
        return self.hashes(at[heads]), np.add.reduceat(new_page.astype(np.int64), heads)

    def covered(self, repeated: np.ndarray) -> list[list[int]]:
        """For each page the numbers of the blocks that repeated substrings (their hashes) cover."""
        starts = self.starts[np.isin(self.hashes(self.starts), repeated)]
        change = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + MIN_TOKENS, -1)
        total = np.concatenate([[0], np.cumsum(np.cumsum(change)[:-1] > 0)])
        ends = np.cumsum(self.counts)
        share = (total[ends] - total[ends - self.counts]) / np.maximum(self.counts, 1)
        out: list[list[int]] = [[] for _ in self.sids]
        for k in np.flatnonzero((share >= COVERED) & (self.numbers >= 0)):
            out[self.row[k]].append(int(self.numbers[k]))
        return out


def covered_blocks(parsed: DataFrame, scratch: Scratch, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(host, sid, covered): the numbers of a page's blocks that substrings repeated on its host cover."""
    streams = parsed.where("stream is not null").select("host", "sid", "stream", "numbers", "n_tokens")
    blocks = F.ceil(F.sum("n_tokens") / block_tokens)
    large = scratch.cut(streams.groupBy("host").agg(blocks.alias("n_blocks")).where("n_blocks > 1"), "large-hosts")
    if large.count() <= BROADCAST_ROWS:
        dealt = streams.join(F.broadcast(large), "host", "left")
    else:
        spread = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        dealt = streams.withColumn("salt", F.pmod("sid", F.lit(SALTS))).join(spread, ["host", "salt"], "left").drop("salt")
    dealt = dealt.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1))).withColumn("block", F.pmod("sid", F.col("n_blocks")))
    dealt = dealt.select("host", "block", "n_blocks", "sid", "stream", "numbers")

    def count(key: tuple, table: pa.Table) -> pa.Table:
        h, n = _Stretches(table).groups()
        if table.column("n_blocks")[0].as_py() == 1:  # no other block knows of its pages
            h, n = h[n >= MIN_PAGES], n[n >= MIN_PAGES]
        return pa.table({"host": pa.array([key[0].as_py()] * len(h), pa.string()), "block": pa.array(np.full(len(h), key[1].as_py(), np.int64)), "h": pa.array(h), "n": pa.array(n)})

    def mark(key: tuple, table: pa.Table, often: pa.Table) -> pa.Table:
        pages = _Stretches(table) if table.num_rows else None
        found = pages.covered(often.column("h").to_numpy()) if pages else []
        keep = [k for k, c in enumerate(found) if c]
        return pa.table({"host": pa.array([key[0].as_py()] * len(keep), pa.string()), "sid": pa.array([int(pages.sids[k]) for k in keep], pa.int64()), "covered": pa.array([found[k] for k in keep], pa.list_(pa.int32()))})

    groups = scratch.cut(dealt.groupBy("host", "block").applyInArrow(count, "host string, block long, h long, n long"), "suffix-groups")
    often = groups.groupBy("host", "h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_PAGES).select("host", "h")
    back = groups.select("host", "block", "h").join(often, ["host", "h"], "left_semi")
    return dealt.groupBy("host", "block").cogroup(back.groupBy("host", "block")).applyInArrow(mark, "host string, sid long, covered array<int>")


def extract(pages: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_removed, n_repeated of every row of ``pages`` (page_id, url, html).

    ``n_repeated``: how many of the removed blocks the host's suffix array has found repeated.
    """
    scratch = Scratch(pages.sparkSession)
    parsed = scratch.cut(parse_pages(pages), "parsed-pages")
    covered = scratch.cut(covered_blocks(parsed, scratch, block_tokens), "covered-blocks")
    side = F.broadcast(covered) if covered.count() <= COVERED_ROWS else covered
    rows = parsed.select("page_id", "url", "host", "sid", "texts", "kinds", "places", "main", "n_blocks").join(side, ["host", "sid"], "left")
    none = F.array().cast("array<int>")
    rows = rows.withColumn("covered", F.coalesce("covered", none))
    block = F.arrays_zip("texts", F.split("kinds", "").alias("kinds"), F.col("places").alias("place"))
    rows = rows.withColumn("blocks", F.when(F.size("texts") > 0, block)).withColumn("kept_kinds", F.when(F.col("main"), F.lit("pm")).otherwise(F.lit("po")))
    allowed = F.filter("blocks", lambda b: F.col("kept_kinds").contains(b["kinds"]) & (b["kinds"] != "") & b["place"].isNotNull())
    rows = rows.withColumn("allowed", F.coalesce(allowed, F.expr("array()").cast("array<struct<texts:string,kinds:string,place:int>>")))
    kept = F.filter("allowed", lambda b: (b["kinds"] == "p") | ~F.array_contains("covered", b["place"]))
    rows = rows.withColumn("left", kept).withColumn("left", F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("allowed")))
    text = F.concat_ws("\n", F.transform("left", lambda b: b["texts"]))
    repeated = F.size(F.array_except("covered", F.transform("left", lambda b: b["place"])))
    out = rows.select("page_id", "url", text.alias("text"), "n_blocks", (F.col("n_blocks") - F.size("left")).alias("n_removed"), repeated.alias("n_repeated"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_removed", "n_repeated")
