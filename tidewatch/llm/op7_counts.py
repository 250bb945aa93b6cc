"""Token counts by a compiled finite-state transducer.

The merges of the SentencePiece BPE model are compiled into the automaton of bpe.py, whose arcs are annotated with the tokens that they emit: one for a
piece, as many as its bytes for a character outside the vocabulary. A word's count is the sum of the annotations along its path. Before a word mark that follows
another character, and around a line break that no piece has, the transducer is back in its start state, so a text's count is the sum over its words.

Texts over ``CHUNK`` characters are dealt to many tasks in chunks. A chunk's state map tells, for each token that may lie over the chunk's first
border, which token then lies over its last border and how many tokens were emitted between; where the border is a start of a word there is one such
state. The maps of a text compose, associatively, by a prefix scan: groups of ``GROUP`` neighbours are composed in parallel, then groups of
those, until one map is left. So neither a text of any length nor its chunks are the work of one task.

Null and empty texts count no tokens. Special strings inside a text are ordinary text. Repeated rows each give a row, a null doc_id stays null, an empty table gives no rows and other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import WIDE, MergeAutomaton
from tidewatch.llm.common import arrow_map, materialise, table, texts_of, with_text

MARK = "▁"
#: Distinct words that a worker keeps between batches.
MEMO = 300_000
#: Characters of a chunk, and neighbours that one task composes.
CHUNK, GROUP = 1 << 16, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
CHUNKS = "doc_id long, row_key long, copies long, n_bytes long, no long, before string, body string, after string, inside boolean, open boolean"
MAPS = "doc_id long, row_key long, copies long, n_bytes long, no long, map array<struct<a:int,b:int,n:bigint>>"
#: The one state at a border where a word starts, or a text starts or ends.
BORDER = 0

StateMap = dict[int, dict[int, int]]


def compose(first: StateMap, then: StateMap) -> StateMap:
    """First one chunk, then the next; each start has one way to each end."""
    return {a: {c: n + m for b, n in ends.items() if b in then for c, m in then[b].items()} for a, ends in first.items()}


class CountTransducer:
    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [(i, sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        ids = {s: i for i, s, _ in pieces}
        if any(MARK in s[1:] and s.strip(MARK) for s in ids):
            raise ValueError("a piece spans words: this model has no state that words return to")
        if any(c not in ids for s in ids for c in s):
            raise ValueError("a piece has a character that is no piece")
        self.marks = {len(s) for s in ids if not s.strip(MARK)}
        words = sorted((x for x in pieces if len(x[1]) > 1 and x[1].strip(MARK)), key=lambda x: (-x[2], x[0]))
        merges = [(ids[s[:k]], ids[s[k:]], i) for i, s, _ in words for k in range(1, len(s)) if s[:k] in ids and s[k:] in ids]
        # runs of marks are counted by themselves: their pieces share one score, so they merge from the left
        self.automaton = MergeAutomaton({i: tuple(map(ord, s)) for s, i in ids.items() if len(s) == 1 or s.strip(MARK)}, merges)
        self.characters = {s for s in ids if len(s) == 1}
        self.newline = not any("\n" in s for s in ids)
        self.findall = regex.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+" if self.newline else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.start = regex.compile(f"(?<!{MARK}){MARK}|\n" if self.newline else f"(?<!{MARK}){MARK}")
        self.memo: dict[str, int] = {}

    def run_of_marks(self, k: int) -> int:
        """Tokens of k marks: again and again the leftmost pair of neighbours that is a piece merges."""
        done = 0
        while True:
            parts = [1] * min(k, 64)
            while (j := next((j for j in range(len(parts) - 1) if parts[j] + parts[j + 1] in self.marks), None)) is not None:
                parts[j : j + 2] = [parts[j] + parts[j + 1]]
            if k <= 64:
                return done + len(parts)
            done, k = done + 1, k - parts[0]  # the first part is as long as a piece can be

    def emitted(self, words: list[str]) -> list[int]:
        """Tokens that the arcs along each word emit; all words are of one length and have one mark at most."""
        symbols = np.array([[ord(c) for c in w] for w in words], np.int64)
        last, size = self.automaton.paths(symbols)
        m, n = symbols.shape
        width = 1 + (symbols > 0x7F) + (symbols > 0x7FF) + (symbols > 0xFFFF)
        total, rows = np.zeros((m, n + 1), np.int64), np.arange(m)
        for i in range(1, n + 1):
            total[:, i] = total[rows, i - size[:, i]] + np.where(last[:, i] == self.automaton.unknown, width[:, i - 1], 1)
        return total[:, n].tolist()

    def over(self, text: str, border: int) -> list[tuple[int, int, int]]:
        """Tokens that may lie over a border inside a word: symbols before it, symbols after it, token."""
        out, a = [], self.automaton
        for d in range(1, min(border, a.longest) + 1):
            node = 0
            for i in range(border - d, min(len(text), border - d + a.longest)):
                node = a.children.get(node * a.sigma + ord(text[i]), -1) if ord(text[i]) < a.sigma else -1
                if node < 0:
                    break
                if i + 1 >= border and a._accept[node] >= 0:
                    out.append((d, i + 1 - border, a._accept[node]))
        if border and text[border - 1] not in self.characters:
            out.append((1, 0, a.unknown))
        return out

    def walk(self, text: str, token: int | None, border: int | None = None) -> dict[int, int]:
        """From the state after a token, or the start, over text: tokens emitted up to its end, or up to and with each token over the border; keys name the latter.

        Leading marks of a word count too, by whether its first token is the last of them alone.
        """
        a = self.automaton
        lead = len(text) - len(text.lstrip(MARK)) if token is None else 0
        skip = max(0, lead - 1)
        n = len(text) - skip
        border = None if border is None else border - skip
        held: list[tuple[int, int, int] | None] = [None] * (n + 1)  # emitted, last token, length of the first one
        held[0] = (0, -1 if token is None else token, 0)
        out: dict[int, int] = {}
        alone, joined = (self.run_of_marks(lead) - 1, self.run_of_marks(lead - 1)) if skip else (0, 0)
        for j in range(n if border is None else border):
            at = held[j]
            if at is None:
                continue
            count, before, first = at
            state, node = a.start if before < 0 else a._targets[before], 0
            steps = []
            for i in range(j, min(n, j + a.longest)):
                x = ord(text[skip + i])
                node = a.children.get(node * a.sigma + x, -1) if x < a.sigma else -1
                if node < 0:
                    break
                t = a._accept[node]
                if t >= 0 and a.has_arc(state, t):
                    steps.append((i + 1, t, 1))
            if text[skip + j] not in self.characters:
                steps.append((j + 1, a.unknown, len(text[skip + j].encode())))
            for end, t, emits in steps:
                got = (count + emits, t, first or end)
                if border is not None and end >= border:
                    out[self.key(border - j, end - border)] = got[0] + (alone if got[2] == 1 else joined)
                else:
                    held[end] = got
        if border is None and held[n] is not None:
            out[BORDER] = held[n][0] + (alone if held[n][2] == 1 else joined)
        return out

    @staticmethod
    def key(before: int, after: int) -> int:
        return before * 1000 + after + 1

    def word(self, w: str) -> int:
        """Tokens of one word with its marks, by the scalar walk."""
        return self.run_of_marks(len(w)) if not w.strip(MARK) else self.walk(w, None)[BORDER]

    def learn(self, words: set[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            if w not in self.memo:
                if len(w) > WIDE or w.startswith(MARK * 2) or w == MARK:
                    self.memo[w] = self.word(w)
                else:
                    by_size.setdefault(len(w), []).append(w)
        for same in by_size.values():
            self.memo.update(zip(same, self.emitted(same), strict=True))

    def count(self, text: str) -> int:
        """Tokens of a text of whole words, with marks for spaces."""
        words = self.findall(text)
        self.learn(set(words))
        return sum(map(self.memo.__getitem__, words))

    def borders(self, text: str, chunk: int) -> list[tuple[int, bool]]:
        """Borders of chunks of about that many characters, and whether each is inside a word: the next start of a word, or where there is none for a whole
        chunk, a place with as many characters of the word before it as a piece can have."""
        chunk = max(chunk, self.automaton.longest)  # no token lies over two borders
        out, at = [(0, False)], chunk
        while at < len(text):
            m = self.start.search(text, at, min(len(text), at + chunk))
            if m:
                out.append((m.start(), False))
            else:
                mark = text.rfind(MARK, out[-1][0], min(len(text), at + chunk))
                place = max(at, mark + 1 + self.automaton.longest)
                if text.rfind("\n", max(0, place - self.automaton.longest), place) >= 0 or place >= min(len(text), at + chunk):
                    at += chunk
                    continue
                out.append((place, True))
            at = out[-1][0] + chunk
        return out

    def state_map(self, before: str, body: str, after: str, inside: bool, open_: bool) -> StateMap:
        """What a chunk does: from each token over its first border to each over its last."""
        words = self.findall(body)
        size = len(body)
        if inside:  # the rest of the word that the border cuts
            head = words.pop(0) if words and not words[0].startswith((MARK, "\n")) else ""
        else:
            head = ""
        tail = words.pop() if words and open_ else ""
        self.learn(set(words))
        middle = sum(map(self.memo.__getitem__, words))
        more = (self.findall(after) or [""])[0]
        rest = more if open_ and not more.startswith((MARK, "\n")) else ""  # what follows of the word that the last border cuts
        starts = [(self.key(d, e), e, t) for d, e, t in self.over(before + body + rest, len(before))] if inside else [(BORDER, 0, None)]
        exits = self.walk(tail + rest, None, len(tail)) if tail else {BORDER: 0}
        out: StateMap = {}
        for name, e, token in starts:
            if not inside:
                out[name] = {k: middle + n for k, n in exits.items()}
            elif open_ and len(head) == size:  # the word goes on over both borders
                if e <= size:
                    out[name] = self.walk(head[e:] + rest, token, size - e)
            elif e <= len(head) and (done := self.walk(head[e:], token)):
                out[name] = {k: done[BORDER] + middle + n for k, n in exits.items()}
        return out

    def chunks(self, text: str, chunk: int = CHUNK) -> Iterator[tuple[str, str, str, bool, bool]]:
        """Chunks of a text: what lies before, its body, what lies after, and whether each border is inside a word."""
        marks, near = self.borders(text, chunk), self.automaton.longest
        for (a, inside), (b, open_) in zip(marks, [*marks[1:], (len(text), False)], strict=True):
            yield text[max(0, a - near) : a], text[a:b], text[b : b + near], inside, open_

    def total(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text, through the maps of its chunks."""
        if not text:
            return 0
        maps = [self.state_map(*c) for c in self.chunks(marked(text), chunk)]
        while len(maps) > 1:
            maps = [compose(maps[k], maps[k + 1]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0][BORDER][BORDER]


def marked(text: str) -> str:
    """A text as the model reads it: a mark before it and for each space."""
    return MARK + text.replace(" ", MARK)


@lru_cache(maxsize=2)
def transducer(model_file: str) -> CountTransducer:
    return CountTransducer(model_file)


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def short_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts of one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            # one pass for the words that the whole batch lacks, then each text by look-ups; the memo starts afresh between batches only
            if len(t.memo) > MEMO:
                t.memo.clear()
            split = [t.findall(marked(x)) if x else [] for x in texts]
            t.learn(set().union(*split))
            n = [sum(map(t.memo.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")


def long_counts(docs: DataFrame, model_file: str, chunk: int, group: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of texts of several chunks: a map per chunk, composed group by group."""
    texts = docs.groupBy(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64("text").alias("row_key"), "text").agg(F.count("*").alias("copies"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            for doc, key, text, copies in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text", "copies")), strict=True):
                size = len(text.encode())
                for k, parts in enumerate(t.chunks(marked(text), chunk)):
                    yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(columns(CHUNKS), (doc, key, copies, size, k, *parts), strict=True)}, schema=CUT_SCHEMA)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(model_file)
        for batch in batches:
            if len(t.memo) > MEMO:
                t.memo.clear()
            maps = [t.state_map(*parts) for parts in zip(*(batch.column(c).to_pylist() for c in ("before", "body", "after", "inside", "open")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_key", "copies", "n_bytes", "no")), pa.array(map(listed, maps), MAP_TYPE)], MAP_NAMES)

    def join(block: pa.Table) -> pa.Table:
        rows = sorted(block.to_pylist(), key=lambda r: r["no"])
        whole = held(rows[0]["map"])
        for r in rows[1:]:
            whole = compose(whole, held(r["map"]))
        return pa.table({**{c: pa.array([rows[0][c]], pa.int64()) for c in MAP_NAMES[:4]}, "no": pa.array([rows[0]["no"] // group], pa.int64()), "map": pa.array([listed(whole)], MAP_TYPE)})

    chunks = arrow_map(texts, cut, CHUNKS).repartition("doc_id", "row_key", "no")
    maps = materialise(arrow_map(chunks, measure, MAPS), "maps")
    while not maps.where("no > 0").isEmpty():
        maps = materialise(maps.groupBy("doc_id", "row_key", F.expr(f"no div {group}").alias("part")).applyInArrow(join, MAPS), "maps")
    out = maps.select(F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")).alias("doc_id"), "n_bytes", F.col("map")[0]["n"].alias("n_tokens"), F.expr("explode(sequence(1, copies))").alias("copy"))
    return out.drop("copy")


CUT_SCHEMA = pa.schema([(c, pa.int64()) for c in columns(CHUNKS)[:5]] + [(c, pa.string()) for c in columns(CHUNKS)[5:8]] + [(c, pa.bool_()) for c in columns(CHUNKS)[8:]])
MAP_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
MAP_NAMES = ["doc_id", "row_key", "copies", "n_bytes", "no", "map"]


def listed(m: StateMap) -> list[dict]:
    return [{"a": a, "b": b, "n": n} for a, ends in m.items() for b, n in ends.items()]


def held(rows: list[dict]) -> StateMap:
    out: StateMap = {}
    for r in rows:
        out.setdefault(r["a"], {})[r["b"]] = r["n"]
    return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each document."""
    base = with_text(docs)
    out = short_counts(base.where(F.length("text") <= chunk), model_file).union(long_counts(base.where(F.length("text") > chunk), model_file, chunk, group))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
