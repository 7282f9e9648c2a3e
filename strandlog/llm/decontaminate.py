"""Benchmark decontamination by template windows, in built-in column functions only.

A text becomes tokens: numbers, units behind numbers, and names (a capitalised word inside a sentence) are replaced by
typed placeholders, everything else is lower-cased words. Each window of WINDOW tokens of each text is hashed and joined with the windows of
all benchmark items. A text with fewer tokens is one window of all of them, so a short item ("Yes", "5 apples") is found
where it is a document's whole text, not in every document that uses its words. An item is leaked into a document if SHARE of its distinct windows stand there and
its slots are consistent: over the matched windows at one place of the document (that with most slots), each value at the
item's placeholders corresponds to one value of the document and the reverse, for SLOTS of the values at least, so the same question with other numbers is found, but not
texts that share only a shape.

The benchmark side is broadcast if it has at most BROADCAST_ROWS windows (counted); beyond that Spark shuffles both sides by hash.

Defined results: null and empty texts have no tokens and leak nothing; items of placeholders alone ("42") are no items;
ties between places with equally many slots go to the one with more consistent slots; rows with equal doc_id are one document; items with
equal ids are one item, of all their windows; null ids are ids like any other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandlog.llm.common import Scratch, without

WINDOW = 8
SHARE = 0.5
SLOTS = 0.8
BROADCAST_ROWS = 1_000_000

# Words that are units when they follow a number.
UNITS = "km m cm mm mi ft in kg g mg lb oz l ml s sec secs second seconds min mins minute minutes h hr hour hours day days week weeks month months year years euro euros dollar dollars usd eur cent cents percent mph kmh kwh w kw v hz gb mb kb"

_NUMBER = r"\p{Nd}+(?:[.,:]\p{Nd}+)*"
_NAME = r"(?<=[^.!?:\s] )(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])"
_UNIT = rf"(\x01n[^ ]+ ) *({'|'.join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))})(?![\p{{L}}\p{{N}}])"


def marked(text: Column) -> Column:
    """The text's tokens; a placeholder's token is SOH (U+0001), its type (n, u or a), and its value."""
    x = F.regexp_replace(text, r"\x01", " ")
    x = F.regexp_replace(x, _NAME, "\x01a$1 ")
    x = F.regexp_replace(x, rf"({_NUMBER})", " \x01n$1 ")
    x = F.lower(F.regexp_replace(x, _UNIT, "$1\x01u$2 "))
    x = F.regexp_replace(x, r"[^\p{L}\p{N}\x01.,:]+|[.,:]+(?!\p{Nd})|(?<!\p{Nd})[.,:]+", " ")
    return F.split(F.trim(F.regexp_replace(x, " +", " ")), " ")


def template(tokens: Column) -> Column:
    """Marked tokens with the values of placeholders taken away."""
    return F.transform(tokens, lambda t: F.when(t.startswith("\x01"), F.substring(t, 1, 2)).otherwise(t))


def _windows(texts: DataFrame, key: str, window: int) -> DataFrame:
    """(key, tokens, hashes) of ``texts`` (key, tokens): hashes of all windows of the tokens' templates, in order.

    Of fewer tokens all are one window. The generator between keeps the template a column, which is made once and not for
    each window.
    """
    plain, size = F.col("plain"), F.size("plain")
    several = F.transform(F.sequence(F.lit(1), size - window + 1), lambda i: F.xxhash64(F.slice(plain, i, window)))
    hashes = F.when(size >= window, several).otherwise(F.array(F.xxhash64(plain)))
    return texts.select(key, "tokens", template(F.col("tokens")).alias("plain")).select(key, "tokens", F.explode(F.array(hashes)).alias("hashes"))


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, h, place, n_windows, slots): every item's windows, how many distinct ones it has, their marked tokens."""
    items = benchmark.where("text is not null").select("item_id", marked(F.col("text")).alias("tokens"))
    items = items.where(F.exists("tokens", lambda t: (t != "") & ~t.startswith("\x01")))
    rows = _windows(items, "item_id", window).select("item_id", "tokens", F.posexplode("hashes").alias("place", "h"))
    rows = rows.select("item_id", "h", "place", F.slice("tokens", F.col("place") + 1, window).alias("slots")).distinct()
    sizes = rows.groupBy("item_id").agg(F.count_distinct("h").alias("n_windows"))
    return rows.alias("r").join(sizes.alias("s"), F.col("r.item_id").eqNullSafe(F.col("s.item_id"))).select("r.*", "n_windows")


def _doc_windows(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, tokens, hashes) of every document."""
    tokens = docs.where("text is not null").select("doc_id", marked(F.col("text")).alias("tokens"))
    return _windows(tokens, "doc_id", window)


def _same(x: str, y: str, *names: str) -> Column:
    on = F.lit(True)
    for n in names:
        on = on & F.col(f"{x}.{n}").eqNullSafe(F.col(f"{y}.{n}"))
    return on


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, slots: float = SLOTS) -> DataFrame:
    """(doc_id, item_id, matched, n_windows, n_slots, n_consistent): the items that leaked into documents."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.cut(item_windows(benchmark, window), "benchmark-windows")
    side = items.select("item_id", "h", "n_windows").distinct()
    side = F.broadcast(side) if items.count() <= BROADCAST_ROWS else side
    rows = _doc_windows(docs, window).select("doc_id", F.explode("hashes").alias("h"))
    found = rows.join(side, "h").groupBy("doc_id", "item_id", "n_windows").agg(F.count_distinct("h").alias("matched"))
    likely = scratch.cut(found.where(F.col("matched") >= F.col("n_windows") * share), "likely-leaks")

    # slots: only documents that hold most of an item that has placeholders are looked at again
    with_slots = items.where(F.exists("slots", lambda t: t.startswith("\x01")))
    pairs = likely.select("doc_id", "item_id").alias("l").join(with_slots.alias("w"), _same("l", "w", "item_id")).select("doc_id", "l.item_id", "h", "place", "slots")
    pairs = scratch.cut(pairs, "slot-windows")
    wanted = pairs.select("doc_id").distinct()
    again = _doc_windows(docs.alias("d").join(wanted.alias("q"), _same("d", "q", "doc_id"), "left_semi"), window).select("doc_id", "tokens", F.posexplode("hashes").alias("at", "h"))
    both = again.alias("a").join(pairs.alias("p"), _same("a", "p", "doc_id", "h")).select("a.doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift"), F.zip_with("slots", F.slice("tokens", F.col("at") + 1, F.size("slots")), lambda i, d: F.struct(i.alias("i"), d.alias("d"))).alias("pairs"))
    values = both.select("doc_id", "item_id", "shift", F.explode(F.filter("pairs", lambda p: p["i"].startswith("\x01"))).alias("p")).select("doc_id", "item_id", "shift", "p.i", "p.d").distinct()
    values = scratch.cut(values, "slot-values")
    of_item = values.groupBy("doc_id", "item_id", "shift", "i").agg(F.count("*").alias("n"))
    of_doc = values.groupBy("doc_id", "item_id", "shift", "d").agg(F.count("*").alias("m"))
    judged = values.alias("v").join(of_item.alias("x"), _same("v", "x", "doc_id", "item_id", "shift", "i")).join(of_doc.alias("y"), _same("v", "y", "doc_id", "item_id", "shift", "d"))
    per_shift = judged.groupBy("v.doc_id", "v.item_id", "v.shift").agg(F.count_distinct("v.i").alias("n_slots"), F.count_distinct(F.when((F.col("n") == 1) & (F.col("m") == 1), F.col("v.i"))).alias("n_consistent"))
    best = F.max(F.struct("n_slots", "n_consistent"))  # the place in the document where most of the item's slots are
    per_item = per_shift.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
    out = likely.alias("l").join(per_item.alias("j"), _same("l", "j", "doc_id", "item_id"), "left")
    out = out.select("l.doc_id", "l.item_id", "matched", "n_windows", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), F.coalesce("n_consistent", F.lit(0)).alias("n_consistent"))
    return out.where(F.col("n_consistent") >= F.col("n_slots") * slots)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that any benchmark item leaked into."""
    return without(docs, leaks(docs, benchmark))


def oracle(window: int = WINDOW, share: float = SHARE, slots: float = SLOTS) -> str:
    """leaks() in DuckDB SQL, whose patterns know no look-around: names are marked twice, number separators token by token."""
    units = "|".join(sorted(UNITS.split(), key=lambda u: (-len(u), u)))
    one, two = "' || chr(1) || '", "' || chr(2) || '"
    name = f"regexp_replace({{}}, '([^.!?:\\s] )(\\p{{{{Lu}}}}\\p{{{{Ll}}}}+)([^\\p{{{{L}}}}\\p{{{{N}}}}]|$)', '\\1{one}a\\2{two}\\3', 'g')"
    x = "replace(text, chr(1), ' ')"
    for _ in range(2):
        x = name.format(x)
    x = f"replace({x}, chr(2), ' ')"
    x = f"regexp_replace({x}, '(\\p{{Nd}}+(?:[.,:]\\p{{Nd}}+)*)', ' {one}n\\1 ', 'g')"
    x = f"lower(regexp_replace({x}, '({one}n[^ ]+ ) *({units})([^\\p{{L}}\\p{{N}}]|$)', '\\1{one}u\\2 \\3', 'g'))"
    x = f"string_split(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}{one}.,:]+', ' ', 'g'), ' ')"
    x = f"list_transform({x}, lambda t: CASE WHEN starts_with(t, chr(1) || 'n') THEN t ELSE regexp_replace(t, '[.,:]+', ' ', 'g') END)"
    tokens = f"list_filter(string_split(array_to_string({x}, ' '), ' '), lambda t: t <> '')"
    plain = "list_transform(tokens, lambda t: CASE WHEN starts_with(t, chr(1)) THEN t[1:2] ELSE t END)"
    return f"""
    WITH bt AS (SELECT item_id, {tokens} AS tokens FROM benchmark WHERE text IS NOT NULL),
    bp AS (SELECT item_id, tokens, {plain} AS plain, least(len(tokens), {window}) AS w FROM bt WHERE len(list_filter(tokens, lambda t: NOT starts_with(t, chr(1)))) > 0),
    bi AS (SELECT item_id, tokens, plain, w, unnest(range(1, len(plain) - w + 2)) AS i FROM bp),
    bw AS (SELECT DISTINCT item_id, w, i AS place, array_to_string(plain[i:i + w - 1], ' ') AS h, tokens[i:i + w - 1] AS slots FROM bi),
    sizes AS (SELECT item_id, count(DISTINCT h) AS n_windows FROM bw GROUP BY item_id),
    dt AS (SELECT doc_id, {tokens} AS tokens FROM documents WHERE text IS NOT NULL),
    dp AS (SELECT doc_id, tokens, {plain} AS plain, least(len(tokens), {window}) AS w FROM dt WHERE len(tokens) > 0),
    di AS (SELECT doc_id, tokens, plain, w, unnest(range(1, len(plain) - w + 2)) AS i FROM dp),
    dw AS (SELECT doc_id, w, i AS pos, array_to_string(plain[i:i + w - 1], ' ') AS h, tokens[i:i + w - 1] AS found FROM di),
    hits AS (SELECT doc_id, item_id, dw.w, pos - place AS shift, slots, found, h FROM dw JOIN bw USING (w, h)),
    likely AS (SELECT doc_id, item_id, n_windows, count(DISTINCT h) AS matched FROM hits JOIN sizes USING (item_id) GROUP BY ALL HAVING count(DISTINCT h) >= n_windows * {share}),
    places AS (SELECT doc_id, item_id, shift, slots, found, unnest(range(1, w + 1)) AS k FROM hits SEMI JOIN likely USING (doc_id, item_id)),
    vals AS (SELECT DISTINCT doc_id, item_id, shift, slots[k] AS i, found[k] AS d FROM places WHERE starts_with(slots[k], chr(1))),
    judged AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift, i) AS n, count(*) OVER (PARTITION BY doc_id, item_id, shift, d) AS m FROM vals),
    per_shift AS (SELECT doc_id, item_id, shift, count(DISTINCT i) AS n_slots, count(DISTINCT CASE WHEN n = 1 AND m = 1 THEN i END) AS n_consistent FROM judged GROUP BY ALL),
    per_item AS (SELECT doc_id, item_id, n_slots, n_consistent FROM per_shift QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_slots DESC, n_consistent DESC) = 1)
    SELECT doc_id, item_id, matched, n_windows, coalesce(n_slots, 0) AS n_slots, coalesce(n_consistent, 0) AS n_consistent
    FROM likely LEFT JOIN per_item USING (doc_id, item_id) WHERE coalesce(n_consistent, 0) >= coalesce(n_slots, 0) * {slots}"""
