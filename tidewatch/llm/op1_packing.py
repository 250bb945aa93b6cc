"""Packing by cutting-stock column generation.

A document of n ids gives floor(n / size) full sequences and a tail. Tails are cut from the stock of
``size``-token sequences: the histogram of tail lengths (at most size - 1 numbers, whatever the corpus)
goes to a linear program over patterns, multisets of lengths that fill a sequence exactly. Columns come from
a knapsack dynamic program that prices patterns by the duals, until none improves or the packing leaves
almost nothing. Rounded patterns are dealt to documents by their rank among tails of one length:
where a tail lies follows from its length and rank by arithmetic on the plan. Tails that no whole
pattern takes are laid end to end, in order of length and rank, and cut at sequence ends; the last part
sequence is cut into powers of two. So no sequence has padding.

Ranks come from counts by (partition, length), so no length needs to be sorted in one place. Only tails that no pattern takes go through the shuffle with their ids, as only these may be cut;
which these are follows from one partition and rank for each length.
Null and empty texts are one end id. Repeated rows, repeated and null doc_ids are packed each on its own; a null doc_id stays null. A very long text is encoded by one task, and is full sequences but
for its tail. An empty table gives no pieces; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import PIECES, ByteVocabulary
from tidewatch.llm.common import arrow_map, materialise, table, texts_of, with_text

SIZE = 1024
#: Rows that the Parquet reader holds at once while texts are encoded: 4096 whole texts are large arrays of each task.
READ_ROWS = 512
TABLE = "doc_id long, n long, crcs array<long>, r int, tail_crc long, tail binary, pid int, rank long, full_before long"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cheapest(prices: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """Knapsack DP: the multiset of lengths (index of prices; inf where there is none) with sum size and least price."""
    best = np.full(size + 1, np.inf)
    best[0] = 0
    took = np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        total = prices[1 : c + 1] + best[c - 1 :: -1] if c > 1 else prices[1:2] + best[:1]
        k = int(total.argmin())
        best[c], took[c] = total[k], k + 1
    pattern: dict[int, int] = {}
    c = size
    while c and np.isfinite(best[size]):
        pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
        c -= int(took[c])
    return float(best[size]), pattern


def columns(histogram: dict[int, int], size: int = SIZE, rounds: int = 1500, enough: float = 0.002) -> list[tuple[dict[int, int], float]]:
    """Solve max sum(x) with sum(pattern * x) <= histogram by column generation; (pattern, x) of the basis. Stops early when all but ``enough`` of the tokens are packed."""
    lengths = np.array(sorted(r for r in histogram if histogram[r] > 0), np.int64)
    m = len(lengths)
    if not m:
        return []
    at = {int(r): k for k, r in enumerate(lengths)}
    demand = np.array([histogram[int(r)] for r in lengths], float)
    basis: list[dict[int, int] | None] = [None] * m
    gain, inverse, x = np.zeros(m), np.eye(m), demand.copy()
    tokens = float(demand @ lengths)
    for step in range(rounds):
        duals = gain @ inverse
        prices = np.full(size + 1, np.inf)
        prices[lengths] = np.maximum(duals, 0) + 1e-9 * (size - lengths)  # of equal patterns, long pieces first
        price, pattern = cheapest(prices, size)
        if not pattern or price > 1 - 1e-5 or gain @ x * size >= tokens * (1 - enough):
            break
        column = np.zeros(m)
        for r, k in pattern.items():
            column[at[r]] = k
        d = inverse @ column
        ratio = np.where(d > 1e-9, np.maximum(x, 0) / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x -= theta * d
        x[out] = theta
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
        basis[out], gain[out] = pattern, 1.0
        if step % 250 == 249:  # keep rounding errors small
            full = np.eye(m)
            for k, p in enumerate(basis):
                if p is not None:
                    full[:, k] = 0
                    for r, a in p.items():
                        full[at[r], k] = a
            inverse = np.linalg.inv(full)
            x = inverse @ demand
    return [(p, float(v)) for p, v in zip(basis, x, strict=True) if p is not None and v > 1e-9]


@dataclass
class Plan:
    """Where the k-th tail of each length goes."""

    size: int
    blocks: dict[int, tuple[np.ndarray, list[tuple[int, int, int]]]]  # length: first ranks; (tails a sequence, first sequence, offset)
    covered: dict[int, int]
    stream: dict[int, int]  # length: place in the stream of its first tail that no pattern takes
    cuts: np.ndarray  # where sequences of the stream begin, and its end
    first_stream: int
    sequences: int

    def places(self, r: int, k: int) -> list[tuple[int, int, int, int]]:
        """(from, length, sequence, offset) of each piece of the k-th tail of length r."""
        if k < self.covered.get(r, 0):
            firsts, blocks = self.blocks[r]
            b = int(np.searchsorted(firsts, k, "right")) - 1
            each, seq, offset = blocks[b]
            turn, slot = divmod(k - int(firsts[b]), each)
            return [(0, r, seq + turn, offset + slot * r)]
        s = self.stream[r] + (k - self.covered.get(r, 0)) * r
        out, done = [], 0
        full = int(self.cuts[0])  # sequences of the stream before this place have the full size
        while done < r:
            p = s + done
            if p < full:
                seq, begin, end = p // self.size, p // self.size * self.size, p // self.size * self.size + self.size
            else:
                i = int(np.searchsorted(self.cuts, p, "right")) - 1
                seq, begin, end = full // self.size + i, int(self.cuts[i]), int(self.cuts[i + 1])
            n = min(end - p, r - done)
            out.append((done, n, self.first_stream + seq, p - begin))
            done += n
        return out


def make_plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    solved = sorted(columns(histogram, size), key=lambda c: (-(c[1] % 1), sorted(c[0].items())))
    times = [int(x + 1e-7) for _, x in solved]
    rest = dict(histogram)
    for (pattern, _), t in zip(solved, times, strict=True):
        for r, a in pattern.items():
            rest[r] -= a * t
    while any(v < 0 for v in rest.values()):  # rounding noise in x: take back
        r = next(r for r, v in rest.items() if v < 0)
        k = next(k for k, (p, _) in enumerate(solved) if r in p and times[k])
        times[k] -= 1
        for q, a in solved[k][0].items():
            rest[q] += a
    for k, (pattern, x) in enumerate(solved):  # round up where tails are left for one more
        if x % 1 > 1e-6 and all(rest[r] >= a for r, a in pattern.items()):
            times[k] += 1
            for r, a in pattern.items():
                rest[r] -= a
    seq, covered = 0, dict.fromkeys(histogram, 0)
    blocks: dict[int, list[tuple[int, tuple[int, int, int]]]] = {}
    for (pattern, _), t in zip(solved, times, strict=True):
        if t:
            offset = 0
            for r, a in sorted(pattern.items(), reverse=True):
                blocks.setdefault(r, []).append((covered[r], (a, seq, offset)))
                covered[r] += a * t
                offset += a * r
            seq += t
    stream, total = {}, 0
    for r in sorted(histogram):
        stream[r] = total
        total += (histogram[r] - covered[r]) * r
    cuts = [total // size * size]
    for bit in reversed(range(size.bit_length() - 1)):
        if total % size >> bit & 1:
            cuts.append(cuts[-1] + (1 << bit))
    ready = {r: (np.array([f for f, _ in b]), [x for _, x in b]) for r, b in blocks.items()}
    return Plan(size, ready, covered, stream, np.array(cuts), seq, seq + total // size + len(cuts) - 1)


class TextEncoder:
    """Ids of whole texts as the tokenizers library gives them for a byte-level file, by tiktoken's core over the same vocabulary."""

    def __init__(self, path: str):
        import tiktoken

        vocabulary = ByteVocabulary(path)
        self.added = vocabulary.added
        ranks = {label: i for i, label in vocabulary.label.items() if i not in self.added.values()}
        self.largest = max(vocabulary.label)
        self.core = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        del vocabulary
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def encode(self, text: str) -> list[int]:
        if not self.split or not any(t in text for t in self.added):
            return self.core.encode_ordinary(text)
        out: list[int] = []
        for k, part in enumerate(self.split(text)):
            out += [self.added[part]] if k % 2 else self.core.encode_ordinary(part)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def tokenize(docs: DataFrame, vocabulary_path: str, end_id: int, size: int) -> DataFrame:
    """Per document: crcs of its full sequences, its tail and the tail's rank among those of its length in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rank, full = encoder(vocabulary_path), np.zeros(size, np.int64), 0
        kind = "<u2" if max(enc.largest, end_id) < 1 << 16 else "<u4"
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in texts_of(batch.column("text")):
                ids = np.array([*enc.encode(text), end_id], "<u4")
                n = len(ids)
                q, r = divmod(n, size)
                tail = ids[q * size :]
                row = (n, [zlib.crc32(ids[k * size : (k + 1) * size].tobytes()) for k in range(q)], r, zlib.crc32(tail.tobytes()), tail.astype(kind).tobytes(), int(rank[r]), full)
                rank[r] += 1
                full += q
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            n_, crcs, r_, tail_crc, tail_, rank_, full_ = cols
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(r_, pa.int32()), pa.array(tail_crc, pa.int64()), pa.array(tail_, pa.binary()), batch.column("pid"), pa.array(rank_, pa.int64()), pa.array(full_, pa.int64())],
                ["doc_id", "n", "crcs", "r", "tail_crc", "tail", "pid", "rank", "full_before"],
            )

    return arrow_map(with_text(docs).withColumn("pid", F.spark_partition_id()), run, TABLE)


def placed(tails: DataFrame, covered: dict[int, int]) -> DataFrame:
    """Tails with the number of those of their length in partitions before; ids only of those that no pattern takes, null in the others. covered: of each length the tails that patterns take."""
    counts = tails.groupBy("pid", "r").agg(F.count("*").alias("n"))
    above = Window.partitionBy("r").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("pid", "r", F.col("n").alias("here"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("ranked_before"))
    taken = tails.sparkSession.createDataFrame(sorted(covered.items()), "r int, covered long")
    # a row for each length, size - 1 at most: the first tail that no pattern takes
    first = bases.join(F.broadcast(taken), "r").where("covered >= ranked_before and covered < ranked_before + here").select("r", F.col("pid").alias("first_pid"), (F.col("covered") - F.col("ranked_before")).alias("first_rank"))
    free = F.expr("pid > first_pid or (pid = first_pid and rank >= first_rank)")
    slim = tails.join(F.broadcast(first), "r", "left").withColumn("tail", F.when(free, F.col("tail"))).drop("first_pid", "first_rank")
    return slim.join(bases.drop("here"), ["pid", "r"])


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    spark = docs.sparkSession
    reader = "spark.sql.parquet.columnarReaderBatchSize"
    rows = spark.conf.get(reader)
    spark.conf.set(reader, str(READ_ROWS))
    try:
        tails = materialise(tokenize(docs, vocabulary_path, end_id, size), "pack")
    finally:
        spark.conf.set(reader, rows)
    # at most size - 1 lengths, and one row per partition: neither grows with the rows
    histogram = {x["r"]: x["n"] for x in tails.where("r > 0").groupBy("r").agg(F.count("*").alias("n")).collect()}
    plan = make_plan(histogram, size)
    first_full, before = {}, plan.sequences
    for x in sorted(tails.groupBy("pid").agg(F.sum(F.size("crcs")).alias("n")).collect()):
        first_full[x["pid"]], before = before, before + x["n"]
    shared = spark.sparkContext.broadcast((plan, first_full))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, first_full = shared.value
        for batch in batches:
            rows = []
            c = {k: batch.column(k).to_pylist() for k in batch.schema.names if k != "tail"}
            tail = batch.column("tail")
            for i, (doc, n, crcs, r) in enumerate(zip(c["doc_id"], c["n"], c["crcs"], c["r"], strict=True)):
                first = first_full[c["pid"][i]] + c["full_before"][i]
                rows += [(doc, k * size, size, crc, n, first + k, 0) for k, crc in enumerate(crcs)]
                if r:
                    places = plan.places(r, c["rank"][i] + c["ranked_before"][i])
                    raw = tail[i].as_buffer() if len(places) > 1 else b""
                    ids = np.frombuffer(raw, f"<u{len(raw) // r}").astype("<u4") if raw else None
                    for a, length, seq, offset in places:
                        crc = c["tail_crc"][i] if len(places) == 1 else zlib.crc32(ids[a : a + length].tobytes())
                        rows.append((doc, n - r + a, length, crc, n, seq, offset))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(7)], names)

    # no more tasks, and so no more files of the result, than texts were encoded in
    joined = placed(tails, plan.covered).coalesce(max(len(first_full), spark.sparkContext.defaultParallelism))
    return arrow_map(joined, run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
