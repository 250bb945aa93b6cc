"""BPE encoding and decoding by a tokenization automaton (see bpe.py).

Texts are split at added tokens and then by the public pre-split pattern (by the library where code points are newer than Unicode 3.2, as their classes depend on the module's version); each distinct piece is
encoded once per worker by the tables of the compiled automaton, and decoded by emitting the labels of its
arcs. Nothing is shuffled: a document needs only itself.

Null or empty texts have no ids and decode to the empty text. Repeated rows give repeated results, a null doc_id stays null, an empty table gives no
rows and other columns are not read. A long text is one row of one task; its words are encoded one by one.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm.bpe import PIECES, ByteVocabulary
from tidewatch.llm.common import arrow_map, table, texts_of, with_text

#: Distinct pieces that a worker keeps between batches; beyond it the memo starts afresh.
MEMO = 300_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def pre_tokenizer(path: str) -> Callable[[str], list]:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str


@lru_cache(maxsize=1)
def later() -> re.Pattern[str]:
    """Code points that Unicode 3.2 had not assigned: modules of different Unicode versions may class them differently."""
    known = lambda c: unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cn", "Cs")
    spans = [(run[0], run[-1]) for on, group in groupby(range(0x110000), known) if on for run in [list(group)]]
    return re.compile("[^" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]")


class Codec:
    """Encodes and decodes whole texts with one vocabulary file. A text with code points that are newer than Unicode 3.2 is pre-split by the library itself, others by the same pattern."""

    def __init__(self, path: str):
        self.vocabulary = ByteVocabulary(path)
        self.plain, self.later, self.library = regex.compile(PIECES).findall, later(), pre_tokenizer(path)
        added = self.vocabulary.added
        self.added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.memo: dict[str, tuple[str, bytes]] = {}

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.later.search(text):
            return self.plain(text)
        return [text[a:b] for _, (a, b) in self.library(text)]

    def pieces(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.split(text)
        return [p for k, part in enumerate(self.added.split(text)) for p in ([part] if k % 2 else self.split(part))]

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that the memo lacks: decimal ids joined by commas, and the labels of their arcs."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [p for p in pieces if p not in self.memo]
        added = self.vocabulary.added
        plain = [p for p in new if p not in added]
        for p, ids in zip(plain, self.vocabulary.encode_words(plain), strict=True):
            self.memo[p] = ",".join(map(str, ids)), self.vocabulary.decode(ids)
        for p in new:
            if p in added:
                self.memo[p] = str(added[p]), self.vocabulary.decode([added[p]])

    def encode(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each text's ids, joined by commas, and its decoded bytes."""
        split = [self.pieces(t) for t in texts]
        self.learn(set().union(*split))
        for pieces in split:
            got = [self.memo[p] for p in pieces]
            yield ",".join([x[0] for x in got]), b"".join([x[1] for x in got])

    def ids(self, text: str) -> list[int]:
        joined = next(self.encode([text]))[0]
        return [int(x) for x in joined.split(",")] if joined else []

    def decode(self, ids: list[int]) -> str:
        return self.vocabulary.decode(ids).decode("utf8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Encode and decode each document: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path)
        for batch in batches:
            rows = []
            for ids, raw in c.encode(texts_of(batch.column("text"))):
                text = raw.decode("utf8", "replace")
                rows.append((ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(with_text(docs), run, SCHEMA)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
