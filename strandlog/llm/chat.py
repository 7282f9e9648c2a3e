"""Conversations to training text through a compiled template, and back.

Rows are dealt by conversation and sorted by turn inside each partition; a task renders them as a stream, so a
conversation with very many turns needs no more memory than a short one; its turns do go through one task, in order, since
they are one text with one digest, so a task may take as long as the longest conversation needs. The output is a table of chunks:
(conv_id, chunk, text, spans), where spans are [from, to) code points of the chunk that a model is to learn (the loss
mask). Texts and roles cannot imitate the template's control strings: behind the first character of every control string
in them an escape mark is put, which reading back takes away.

Defined results: a null text or role is empty; rows of equal turn are in the order of role and text; repeated rows are
repeated turns; a null conv_id or turn sorts first, null being a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlog.llm.template import compile_template

# The control strings of the template, and those of other formats that texts may not imitate.
CONTROLS = ("<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
MARK = "␛"

TEMPLATE = """{%- for message in messages -%}
{{ '<|turn|>' }}{{ message.role | escape }}{{ '<|says|>' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.text | escape }}{% endgeneration %}
{%- else -%}
{{ message.text | escape }}
{%- endif -%}
{{ '<|end|>' ~ '\\n' }}
{%- endfor -%}"""

#: Characters after which a chunk is closed (at the end of a turn).
CHUNK = 1 << 20

_HEADS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_UNMARK = re.compile(f"{MARK}([01])")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|says\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    """A text without control strings, from which ``unescape`` gives the text again."""
    if MARK in text:
        text = text.replace(MARK, MARK + "0")
    return _HEADS.sub(lambda m: m[0] + MARK + "1", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _UNMARK.sub(lambda m: MARK if m[1] == "0" else "", text) if MARK in text else text


_SORTED = ["conv_id", "turn", "role", "text"]


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, chunk, text, spans) of all conversations in ``rows`` (conv_id, turn, role, text)."""
    clean = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = clean.repartition("conv_id").sortWithinPartitions(*_SORTED)
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        feed = ((c, r, x) for b in batches for c, r, x in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True))
        ahead = next(feed, None)

        def turns(conv: int | None) -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv:
                role, text = ahead[1:]
                ahead = next(feed, None)
                yield {"role": role, "text": text}

        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        while ahead is not None:
            conv, chunk, parts, spans, at = ahead[0], 0, [], [], 0
            for text, generated in render({"messages": turns(conv)}):
                if generated and text:
                    spans += (at, at + len(text))
                parts.append(text)
                at += len(text)
                if at >= CHUNK and text.endswith("<|end|>\n"):
                    out.append((conv, chunk, "".join(parts), spans))
                    yield batch()
                    out, held = [], 0
                    chunk, parts, spans, at = chunk + 1, [], [], 0
            if parts or not chunk:
                out.append((conv, chunk, "".join(parts), spans))
                held += at
            if held >= CHUNK:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    return dealt.mapInArrow(run, "conv_id long, chunk long, text string, spans array<long>")


def read_conversations(chunks: DataFrame) -> DataFrame:
    """The digest of every formatted conversation, from its chunks: turns are parsed and texts unescaped again."""
    dealt = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = object(), None, []

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)

        for b in batches:
            for conv, text, spans in zip(*(b.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                at = 0
                for m in _TURN.finditer(text):
                    if m.start() != at:
                        raise ValueError(f"conversation {conv} is not well formed at {at}")
                    at = m.end()
                    state[0] += 1
                    state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                if at != len(text):
                    raise ValueError(f"conversation {conv} is not well formed at {at}")
                for a, z in zip(spans[::2], spans[1::2], strict=True):
                    learned = unescape(text[a:z])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            if len(done) > 4096:
                yield batch()
                done.clear()
        close()
        if done:
            yield batch()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Format all conversations and conversation -1 (control strings as texts), and read the output back."""
    hostile = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return read_conversations(format_conversations(rows))
