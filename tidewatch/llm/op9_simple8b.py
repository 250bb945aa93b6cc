"""Token-id files in Simple-8b: word-aligned coding with escapes and per-block offsets.

A 64-bit word holds a 4-bit selector above 60 bits of payload; the selector says how many ids share the
payload and how wide each is. An id of 2^28 - 1 or more is written as that mark in a wide slot and its value
goes into the block's escape list. A block codes up to BLOCK ids and starts at a word of its own; the
offsets of blocks, in words, let a reader decode any block, and within one block all words at once.

A row of the file table is a run of whole documents: the ids before it in its file, their doc_ids and lengths, the words, the block
offsets, the escapes. Rows lie in ascending doc_id order: documents are range-partitioned by doc_id and
each partition is one file, so no task holds more than its range. Spark's committer writes the files.

Null or empty texts hold just the end id. Equal doc_ids stay side by side, in the order of their texts, so repeated rows are told each with its own start; null doc_ids come first and stay null. A very long
text is one run of ids, cut into blocks. An empty table gives files without rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, gathered, id_bytes, scratch, table, with_text

#: Ids per word and bits per id, by selector; the first two hold only zeros.
SLOTS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS, BITS = np.array([n for n, _ in SLOTS]), np.array([b for _, b in SLOTS], np.uint64)
MARK = (1 << 28) - 1
#: Bits of each id that a token vocabulary can have.
WIDTH = np.frexp(np.arange(1 << 18, dtype=np.float64))[1].astype(np.uint8)
BLOCK = 1 << 14
#: Ids of a row of the file table at least, unless its partition ends.
ROW_IDS = 1 << 16
#: Bytes of text that a worker encodes together.
TOGETHER = 24 << 20
#: Words of letters that a worker remembers from batch to batch, and their longest.
KNOWN, KNOWN_LENGTH = 1 << 19, 32
#: Longest punctuation after letters that is a unit of its own; words with more are encoded whole.
TAIL = 8
FILE_SCHEMA = "part int, before long, doc_ids array<long>, lengths array<long>, n_ids long, words binary, block_words array<long>, escape_at array<long>, escape_value array<long>"
SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_block(ids: np.ndarray) -> np.ndarray:
    """The words of one block of non-negative ids, escapes already marked."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    ids = ids.astype(np.uint64)
    wide = WIDTH[ids] if int(ids.max()) < len(WIDTH) else np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    wide = np.concatenate([wide, np.zeros(239, np.uint8)])  # a last word may be part empty
    best, span = np.full(n, 15, np.uint8), 1
    for size, bits in SLOTS[14::-1]:
        # the widest of the next size ids: no size is more than twice the one before; what fits a selector fits all after it
        wide, span = np.maximum(wide[: len(wide) - (size - span)], wide[size - span :]), size
        best -= wide[:n] <= bits
    step = COUNTS.astype(np.uint8)[best].tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    first = np.array(starts)
    chosen = best[first]
    held = np.diff(first, append=n)
    shift = (np.arange(n) - np.repeat(first, held)).astype(np.uint64) * np.repeat(BITS[chosen], held)
    return np.bitwise_or.reduceat(ids << shift, first) | chosen.astype(np.uint64) << np.uint64(60)


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block, all words at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes, bits = COUNTS[chosen], BITS[chosen]
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    payload = np.repeat(words, sizes) >> place.astype(np.uint64) * np.repeat(bits, sizes)
    return (payload & np.repeat((np.uint64(1) << bits) - np.uint64(1), sizes)).astype(np.int64)[:n]


def encode_ids(ids: np.ndarray) -> tuple[bytes, list[int], list[int], list[int]]:
    """Words, block offsets in words (one more than blocks), escape positions and escaped values."""
    at = np.flatnonzero(ids >= MARK)
    values = ids[at]
    if len(at):
        ids = ids.copy()
        ids[at] = MARK
    blocks = [encode_block(ids[k : k + BLOCK]) for k in range(0, len(ids), BLOCK)]
    offsets = [0, *np.cumsum([len(b) for b in blocks]).tolist()]
    return b"".join(b.astype("<u8").tobytes() for b in blocks), offsets, at.tolist(), values.tolist()


def decode_ids(words: bytes, n: int, offsets: list[int], escape_at: list[int], escape_value: list[int], first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first to last (all of them by default)."""
    w = np.frombuffer(words, "<u8")
    last = len(offsets) - 1 if last is None else last
    out = [decode_block(w[offsets[b] : offsets[b + 1]], min(BLOCK, n - b * BLOCK)) for b in range(first, last)]
    ids = np.concatenate(out) if out else np.zeros(0, np.int64)
    at, values = np.array(escape_at, np.int64) - first * BLOCK, np.array(escape_value, np.int64)
    here = (at >= 0) & (at < len(ids))
    ids[at[here]] = values[here]
    return ids


def laid_out(ids: np.ndarray, sizes: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the chosen units, one unit after the other, and where each unit ends; units lie one after the other in ids."""
    counts = sizes[unit]
    upto = np.cumsum(counts)
    total = int(upto[-1]) if len(upto) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    at = np.repeat(((np.cumsum(sizes) - sizes)[unit] - (upto - counts)).astype(kind), counts)
    at += np.arange(total, dtype=kind)
    return ids[at], upto


class WordEncoder:
    """The library's ids of whole texts, a white-space-delimited word at a time: this vocabulary drops white space, so words stand alone."""

    #: The mark of a last token in the vocabulary, and ASCII punctuation that may follow letters.
    END, STOPS = "</w>", ",.;:!?|%*#&$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        # lower-case ASCII letters pass the normalizer and the split patterns unchanged, so the library's model needs neither for them
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        probe = " ".join(w for w in (t.removesuffix(self.END) for t in sorted(self.library.get_vocab())[::20]) if w.isascii() and w.isalpha() and w.islower())
        if self.bare.encode(probe, add_special_tokens=False).ids != self.library.encode(probe, add_special_tokens=False).ids:
            self.bare = self.library  # another vocabulary
        last = [t.endswith(self.END) for t, _ in sorted(self.library.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])]
        self.ends = np.array(last)
        self.known, self.known_ids, self.known_sizes = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of units, and the unit of each of the distinct words of letters; the first ones met are kept."""
        at = pc.index_in(words, value_set=self.known)
        place = at.fill_null(0).to_numpy().astype(np.int64)
        missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        ascii = pc.string_is_ascii(words.take(pa.array(missing))).to_numpy(zero_copy_only=False).astype(bool)
        missing = np.concatenate([missing[ascii], missing[~ascii]])
        new = words.take(pa.array(missing))
        ids, sizes = self.letters(new.to_pylist())
        place[missing] = len(self.known) + np.arange(len(new))
        units = np.concatenate([self.known_ids, ids]), np.concatenate([self.known_sizes, sizes])
        keep = np.flatnonzero(pc.utf8_length(new).to_numpy() <= KNOWN_LENGTH)[: KNOWN - len(self.known)]
        if len(keep):
            self.known = pa.concat_arrays([self.known, new.take(pa.array(keep))])
            self.known_ids, self.known_sizes = np.concatenate([self.known_ids, laid_out(ids, sizes, keep)[0]]), np.concatenate([self.known_sizes, sizes[keep]])
        return *units, place

    def units(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and how many each has."""
        raw = id_bytes(self.library.encode_batch_fast(words, add_special_tokens=False)) if words else []
        return np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4

    def letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case words of letters alone: each is one unit to the library, so many share a call and last tokens tell them apart."""
        flat, counts = [], []
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            text = " ".join(part)
            ids = np.array((self.bare if text.isascii() else self.library).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(sizes) != len(part):
                ids, sizes = self.units(part)
            flat.append(ids)
            counts.append(sizes)
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each text's end id after its own, and where each text's ids end. Words are told apart and matched by Arrow; the library sees distinct ones."""
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        # letters, and the punctuation after them, are units of their own
        cores = pc.utf8_rtrim(distinct, characters=self.STOPS)
        plain = pc.and_(pc.utf8_is_alpha(cores), pc.invert(pc.match_substring(cores, "\u0130"))).to_numpy(zero_copy_only=False).astype(bool)
        trimmed = (pc.binary_length(distinct).to_numpy() - pc.binary_length(cores).to_numpy()).astype(np.int64)  # punctuation is one byte each
        plain &= trimmed <= TAIL
        rows = np.flatnonzero(plain)
        own = pc.utf8_lower(cores.take(pa.array(rows))).dictionary_encode()  # the library folds case
        stops, tail_of = [""], np.zeros(len(rows), np.int64)
        for n in np.unique(trimmed[rows]).tolist():
            if n:
                at = np.flatnonzero(trimmed[rows] == n)
                tails = pc.utf8_slice_codeunits(distinct.take(pa.array(rows[at])), start=-n).dictionary_encode()
                tail_of[at] = len(stops) + tails.indices.to_numpy()
                stops += tails.dictionary.to_pylist()
        others = np.flatnonzero(~plain)
        *letters, place = self.remembered(own.dictionary)
        parts = [letters, self.units(stops), self.units(distinct.take(pa.array(others)).to_pylist()), (np.array([end], "<u4"), np.array([1]))]
        ids, sizes = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
        shift = np.cumsum([0, *(len(x[1]) for x in parts)])
        # each distinct word is two units, the second often empty; the end id is a word after them
        unit = np.full((len(distinct) + 1, 2), shift[1])
        unit[rows, 0], unit[others, 0], unit[-1, 0] = place[own.indices.to_numpy()], shift[2] + np.arange(len(others)), shift[3]
        unit[rows, 1] = shift[1] + tail_of
        ids, upto = laid_out(ids, sizes, unit.ravel())
        sizes = np.diff(upto[1::2], prepend=0)
        stop = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum() if len(words) else np.zeros(0, np.int64)
        index = np.insert(coded.indices.to_numpy(), stop, len(distinct))
        out, upto = laid_out(ids, sizes, index)
        return out, upto[stop + np.arange(len(stop))]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_files(docs: DataFrame, vocabulary_path: str, target: str, end_id: int, partitions: int | None = None) -> None:
    """Encode documents in ascending doc_id order into files of the format under target."""
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    # the end mark of the range partitions: task number = place in doc_id order
    ordered = with_text(docs).repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, before = encoder(vocabulary_path), 0
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        size, part = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal before, held_ids, held, size
            ids = np.concatenate(held).astype(np.int64)
            words, offsets, at, values = encode_ids(ids)
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([held_ids], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()),
                    pa.array([words], pa.binary()), pa.array([offsets], pa.list_(pa.int64())), pa.array([at], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.int64())),
                ],
                ["part", "before", "doc_ids", "lengths", "n_ids", "words", "block_words", "escape_at", "escape_value"],
            )
            before, held_ids, held, size = before + len(ids), [], [], 0
            return out

        for batch in gathered(batches, TOGETHER):
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            ids, ends = enc.encode(batch.column("text"), end_id)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if len(ends) else ():
                held_ids.append(doc)
                held.append(ids[a:b])
                size += b - a
                if size >= ROW_IDS:
                    yield flush()
        if held:
            yield flush()

    arrow_map(ordered, run, FILE_SCHEMA).write.parquet(target)


def read_files(spark: SparkSession, target: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files."""
    files = spark.read.schema(FILE_SCHEMA).parquet(target)
    rows = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # one row per written partition
    starts, total = {}, 0
    for r in sorted(rows):
        starts[r["part"]], total = total, total + r["n"]
    begin = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = decode_ids(r["words"], r["n_ids"], r["block_words"], r["escape_at"], r["escape_value"]).astype("<u4")
                ends = np.cumsum(r["lengths"])
                first = begin.value[r["part"]] + r["before"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip((ends - r["lengths"]).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(first + ends - r["lengths"], pa.int64()), pa.array(r["lengths"], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return arrow_map(files, run, SCHEMA)


def op9_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    target = scratch(spark, "ids")
    write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), target, end_id=2)
    return read_files(spark, target)
