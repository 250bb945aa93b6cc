"""Periodic runs of words: a harmonic grid of (period, grid point) pairs, whose common extensions are found all at once.

A run of period q and length l is l words of which words q apart are identical; only runs of length ``max(least, times * q)`` or more
count, with their smallest period, as far as no neighbouring word extends them. Words q apart are then equal along l - q
places, at least ``(times - 1) * q``; so among grid points that far apart one lies in every run of that period. The grids of all periods hold
``n log n / (times - 1)`` points in total. From each point where words q apart agree, both extensions (LCE) are found by binary search over prefix
hashes, one NumPy step for all points of all periods. The words of each run found are compared; on a
difference all is done again with another base of the hash, at last by a scan without hashes. Runs of multiples of
a period have the same place and length; the smallest period stays.

Words are `[^\\x20\\x09-\\x0D]+` of whole texts. Null and empty texts have no words and no runs; repeated rows give repeated rows; a null doc_id stays null (and
counts as an empty id where words are replaced); an empty table gives no rows; other columns are not read. Memory of a task is a batch of texts and, for the text at hand, 2^20 grid points.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, table, with_text

#: Least length of a run in words, and in periods.
LEAST, TIMES = 6, 4
#: A prime below 2^31: products of two residues fit into 64 bits. Bases of the hash, in the order they are tried.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 69_069, 1_664_525)
#: Grid points taken together.
POINTS = 1 << 20
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
Change = Callable[["int | None", list[bytes]], list[bytes]]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """At least the first n powers of base modulo PRIME, by doubling; a worker keeps what it has."""
    p = _powers.get(base, np.ones(1, np.int64))
    while len(p) < n:
        p = np.concatenate([p, p * (int(p[-1]) * base % PRIME) % PRIME])
    _powers[base] = p
    return p


def grid(n: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(points, periods): for each period the multiples of the least stretch of equal words, at most POINTS together (or one period)."""
    periods = np.arange(1, n // times + 1)
    steps = np.maximum((times - 1) * periods, least - periods)
    counts = (n - periods - 1) // steps + 1
    upto, first = np.cumsum(counts), 0
    while first < len(periods):
        before = upto[first - 1] if first else 0
        last = max(int(np.searchsorted(upto, before + POINTS, "right")), first + 1)
        c = counts[first:last]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        yield k * np.repeat(steps[first:last], c), np.repeat(periods[first:last], c)
        first = last


def extended(equal: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """The largest length up to most, by element, that equal accepts: one binary search for all."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        fine = equal(middle)
        low, high = np.where(fine, middle, low), np.where(fine, high, middle - 1)
    return low


def candidates(words: np.ndarray, base: int, least: int, times: int) -> dict[tuple[int, int], int]:
    """Period by (start, end) of the runs as the hashes have them."""
    n = len(words)
    power = powers(base, n + 1)
    prefix = np.concatenate([[0], np.cumsum((words + 1) * power[:n] % PRIME)])
    found: dict[tuple[int, int], int] = {}
    for at, q in grid(n, least, times):
        here = np.flatnonzero(words[at] == words[at + q])
        if not len(here):
            continue
        at, q = at[here], q[here]
        shift = power[q]

        def same(a: np.ndarray, b: np.ndarray, q: np.ndarray = q, shift: np.ndarray = shift) -> np.ndarray:
            return (prefix[b] - prefix[a]) % PRIME * shift % PRIME == (prefix[b + q] - prefix[a + q]) % PRIME

        ahead = extended(lambda m: same(at, at + m), n - q - at)  # noqa: B023 (called at once)
        back = extended(lambda m: same(at - m, at), at)  # noqa: B023
        start, end = at - back, at + q + ahead
        long = end - start >= np.maximum(least, times * q)
        for a, b, p in set(zip(start[long].tolist(), end[long].tolist(), q[long].tolist(), strict=True)):
            found[a, b] = min(p, found.get((a, b), p))
    return found


def scanned(words: np.ndarray, least: int, times: int) -> dict[tuple[int, int], int]:
    """The same without hashes, a period at a time."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // times + 1):
        match = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(match[1:] != match[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b + q - a >= max(least, times * q):
                found.setdefault((a, b + q), q)
    return found


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period; words are numbers, equal for equal words."""
    if len(words) < least:
        return []
    for base in BASES:
        found = candidates(words, base, least, times)
        if all(np.array_equal(words[a : b - q], words[a + q : b]) for (a, b), q in found.items()):
            break
    else:
        found = scanned(words, least, times)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, q in runs:
        edge[start + q] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, change: Change | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text and its words, joined by one space, without what runs repeat. ``change`` may replace a text's words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "runs": [], "collapsed": []}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = text.encode().split()  # bytes split at these six characters alone
                if change:
                    words = change(doc, words)
                number: dict[bytes, int] = {}
                runs = runs_of(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)), least, times)
                stay = kept(len(words), runs).tolist() if runs else None
                out["n_words"].append(len(words))
                out["runs"].append([{"start": a, "length": n, "period": q} for a, n, q in runs])
                out["collapsed"].append(b" ".join([w for w, k in zip(words, stay, strict=True) if k] if stay else words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["runs"], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), pa.array(out["collapsed"], pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return arrow_map(with_text(docs), run, SCHEMA)


def periodic(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's replacement: in one text of ten, by its id, the tail repeats a stretch."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


#: SQL: the run of greatest length / period; runs come by start, then period, so the first of equals stays.
BEST = "aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))"


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, one text of ten made periodic first, and digests of runs and collapsed texts."""
    rows = collapse_runs(table(spark, sf_dir, "documents"), change=periodic).withColumn("best", F.expr(BEST))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
