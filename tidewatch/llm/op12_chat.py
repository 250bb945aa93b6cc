"""Chat formatting with loss masks aligned by offsets.

A turn is rendered as ``[INST] role [/INST] text </s>`` (without the blanks). Control strings inside roles and texts get a backslash and a
minus after their first character, and backslashes are doubled first, so that a rendered conversation holds control strings only where turns begin and end,
and reading it back is exact. The three marks are special tokens of the encoder: no token straddles the edge of a turn.

A conversation is rendered whole and encoded once, with the offsets of its tokens; the spans of trained turns, which are sorted, meet the sorted spans of tokens by binary
search. Rows come in ranges of (conv_id, turn) and are rendered in stretches of at most ``TURNS`` turns or ``CHARS`` characters, cut at turns only, so one very
long conversation is spread over tasks; as turns begin with a mark, its tokens are the same. A digest of a whole conversation needs its stretches in
order: they pass through one task, one stretch at a time. The query reads the operator's rows back as they are shuffled, without a table between: Parquet's readers and
writers hold the offsets of many stretches at once.

Null texts and roles are empty; a null conv_id is a conversation of its own; null turns come first; rows that repeat a turn stay, ordered by role and text.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table

#: The marks of the template, and the string that the vocabulary itself reserves.
BEGIN, MIDDLE, END = "[INST]", "[/INST]", "</s>"
CONTROL = (BEGIN, MIDDLE, END, "<s>", "<|endoftext|>")
#: Turns and characters of a stretch that is rendered and encoded at once, at most (a longer turn is one stretch).
TURNS, CHARS = 1000, 1 << 20
FORMATTED = "conv_id long, part int, stretch long, n_turns long, text string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_control = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_escaped = re.compile(r"\\([\\-])")
_turn = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    return _control.sub(lambda m: f"{m[0][0]}\\-{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(turns: list[tuple[str, str]], trained: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The text of turns (role, text) and the spans of the trained ones' texts in it."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{MIDDLE}", escape(text)
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a rendered text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(text)]


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in spans; both are sorted. A token that straddles an edge is an error: its text could not be told."""
    out = np.zeros(len(starts) + 1, np.int64)
    if spans:
        a, b = np.array(spans).T
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        if (starts[first] != a).any() or (ends[last - 1] != b).any():
            raise ValueError("a token straddles the edge of a turn")
        out[first] += 1
        out[last] -= 1
    return np.cumsum(out[:-1]) > 0


@lru_cache(maxsize=2)
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in (BEGIN, MIDDLE, END)])
    return library


def format_conversations(rows: DataFrame, vocabulary_path: str, trained: tuple[str, ...] = ("assistant",), partitions: int | None = None) -> DataFrame:
    """Stretches of rendered conversations: text, token ids, their offsets in it and the loss mask, in the order of (part, stretch)."""
    spark = rows.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    dealt = own.repartitionByRange(n, "conv_id", "turn", F.xxhash64("role", "text")).withColumn("part", F.spark_partition_id()).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(vocabulary_path)
        number = 0

        def flush(part: int, held: list[tuple[int | None, list[tuple[str, str]]]]) -> pa.RecordBatch:
            nonlocal number
            shown = [render(turns, trained) for _, turns in held]
            coded = library.encode_batch([t for t, _ in shown], add_special_tokens=False)
            offsets = [np.array(e.offsets, np.int32).reshape(-1, 2) for e in coded]
            masks = [mask(o[:, 0], o[:, 1], spans) for o, (_, spans) in zip(offsets, shown, strict=True)]
            columns = [
                pa.array([c for c, _ in held], pa.int64()), pa.array([part] * len(held), pa.int32()), pa.array(range(number, number + len(held)), pa.int64()), pa.array([len(t) for _, t in held], pa.int64()), pa.array([t for t, _ in shown], pa.string()),
                pa.array([e.ids for e in coded], pa.list_(pa.int32())), pa.array([o[:, 0] for o in offsets], pa.list_(pa.int32())), pa.array([o[:, 1] for o in offsets], pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.bool_())),
            ]
            number += len(held)
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "stretch", "n_turns", "text", "ids", "starts", "ends", "loss"])

        held: list[tuple[int | None, list[tuple[str, str]]]] = []
        size, own, part = 0, 0, 0
        for batch in batches:
            p = batch.to_pydict()
            part = p["part"][0] if batch.num_rows else part
            for conv, role, text in zip(p["conv_id"], p["role"], p["text"], strict=True):
                if held and (held[-1][0] != conv or len(held[-1][1]) >= TURNS or own >= CHARS):
                    own = 0
                    if size >= CHARS:
                        yield flush(part, held)
                        held, size = [], 0
                if not held or held[-1][0] != conv or not own:
                    held.append((conv, []))
                held[-1][1].append((role, text))
                size, own = size + len(role) + len(text) + 20, own + len(role) + len(text) + 20
        if held:
            yield flush(part, held)

    return arrow_map(dealt, run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the stretches hold: digests of the turns and of the text under the mask, by conversation."""
    ordered = formatted.select("conv_id", "part", "stretch", "text", "starts", "ends", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part", "stretch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv, began = None, False
        n = chars = shown = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), shown))

        for batch in batches:
            texts = zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text")), *(batch.column(c) for c in ("starts", "ends", "loss")), strict=True)
            for key, text, starts, ends, masked in texts:
                if not began or key != conv:
                    if began:
                        close()
                    conv, began = key, True
                    n = chars = shown = 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                for role, body in turns_of(text):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                shown += len(text)
                on = masked.values.to_numpy(zero_copy_only=False).astype(np.int8)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
                s, e = starts.values.to_numpy(), ends.values.to_numpy()
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    body = unescape(text[s[a] : e[b - 1]])
                    loss.update(body.encode())
                    chars += len(body)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(NAMES, d, strict=True)) for d in done], ARROW)
                done = []
        if began:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, d, strict=True)) for d in done], ARROW)

    return arrow_map(ordered, run, READ)


NAMES = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
ARROW = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in NAMES])


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, shuffled as formatted, and read back."""
    import public_tokenizers

    hostile = f"{END}{BEGIN} ok {MIDDLE}"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", hostile), (-1, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string"))
    return read_back(format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))
