"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter, and each word's commonest form.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Of a pair let L be the longer length. One
edit leaves the first or the last ``L // 2`` code points of the longer word as they are, at the same end of the other: these two long grams, with L and their end, are
the keys under which words meet, so a word has four (with its own length and, as the shorter one, the next). Keys of one word fall away. The words of a key are indexed
by their positional bigrams; for each word, the postings of its bigrams, those at the same place of words as long, and at the same or the place before of words one shorter, are
merged by a heap, and words that come up ``L - 3`` times or more, the overlap that one edit leaves, are compared (bigrams of the key count for all, the longest postings are searched instead of merged). Pairs of
words that share both keys are told under the first.

A key with more than ``BLOCK`` words is dealt to blocks by a hash of the words; blocks meet in pairs, so no task holds more than two blocks of a key, and near pairs alone leave it.
The form is the near word of greatest n, if that n is ``RATIO`` times the word's or more; forms are followed to the last by doubling joins over tables: each step multiplies n, so few rounds are needed.

Counts are by whole texts; null texts have no words; a null doc_id counts as an empty id where words are changed; repeated rows count each; an empty table gives no rows; other columns are not
read. Words are compared by code points, texts of one letter run of any length are one word.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import arrow_map, gathered, materialise, table, with_text

#: Code points and occurrences of a word at least; n of a form against n of the word.
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a block of a hot key; bytes of text that a worker counts together.
BLOCK, TOGETHER = 2000, 16 << 20
PAIRS = "word string, n long, other string, other_n long"
_letters = re.compile("[a-zÀ-ÿ]+")
Change = Callable[["int | None", "Counter[str]"], "Iterator[tuple[str, int]]"]


def typos(doc_id: int | None, words: Counter[str]) -> Iterator[tuple[str, int]]:
    """The query's planted slips in a text's words: one code point of a word goes where 199 divides a checksum."""
    begun = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for word, n in words.items():
        h = zlib.crc32(word.encode(), begun)
        yield (word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]), n


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, change: Change | None = None) -> DataFrame:
    """(word, n): maximal runs of letters, A-Z as lower case, and how often they occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, TOGETHER):
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = _letters.findall(text.encode().lower().decode())  # bytes lower A-Z alone
                if change is None:
                    total.update(words)
                    continue
                for word, n in change(doc, Counter(words)):
                    total[word] += n
            words = [w for w in total if len(w) >= least_length]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], ["word", "n"])

    return arrow_map(with_text(docs), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def near(a: str, b: str) -> bool:
    """Whether one edit leads from a to b; b is as long as a or one shorter."""
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + (len(a) == len(b)) :] and a != b


def merged(lists: list[list[list[int]]], bound: int) -> Iterator[int]:
    """Members that the postings of ``bound`` grams or more hold, given each gram's ascending lists. A member of that many is in one of all but the ``bound - 1`` longest at least, so those alone are merged; the others are searched."""
    lists.sort(key=lambda some: sum(map(len, some)))
    rest = len(lists) - bound + 1
    for member, same in groupby(heapq.merge(*(x for some in lists[:rest] for x in some))):
        count = sum(1 for _ in same)
        for some in lists[rest:]:
            count += any((at := bisect_left(x, member)) < len(x) and x[at] == member for x in some)
        if count >= bound:
            yield member


def members_near(members: list[tuple[str, int, int]], longer: int, end: str, apart: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of near members of a key: the first of length ``longer``, the second as long or one shorter. ``apart``: members of different blocks only.

    All members share the bigrams inside the key, ``longer // 2 - 1`` of them, so the index holds the others, and ``longer - longer // 2 - 2`` of these must agree.
    """
    half = longer // 2
    grams, bound = longer - half, longer - half - 2
    postings: dict[tuple[int, str, bool], list[int]] = defaultdict(list)
    own = []
    for j, (word, _, _) in enumerate(members):
        short = len(word) < longer
        first = half - 1 if end == "a" else 0
        own.append([(p, word[p : p + 2]) for p in range(first, first + grams - short)])
        for p, gram in own[j]:
            postings[p, gram, short].append(j)  # ascending: j grows
    for j, (word, _, block) in enumerate(members):
        if len(word) != longer:
            continue
        same = [[postings[p, gram, False]] for p, gram in own[j]]
        shorter = [[x for q in (p, p - 1) if (x := postings.get((q, gram, True)))] for p, gram in own[j]]
        # words under five code points may share no gram at all
        for k in chain(merged(same, bound), merged(shorter, bound)) if bound > 0 else range(len(members)):
            other, _, where = members[k]
            if k == j or (len(other) == longer and k < j) or (apart and where == block):
                continue
            if end == "z" and word[:half] == other[:half]:
                continue  # told under the first key
            if near(word, other):
                yield j, k


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n): all pairs of near words, both ways."""
    keys = "explode(array(" + ", ".join(f"struct({length} as longer, '{end}' as side, {gram} as gram)" for length in ("m", "m + 1") for end, gram in (("a", f"substring(word, 1, ({length}) div 2)"), ("z", f"right(word, ({length}) div 2)"))) + "))"
    rows = words.select("word", "n", F.length("word").alias("m")).select("word", "n", F.expr(keys).alias("k")).select("word", "n", "k.longer", "k.side", "k.gram")
    sizes = rows.groupBy("longer", "side", "gram").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["longer", "side", "gram"]).withColumn("blocks", F.expr(f"cast(ceil(size / {block}.0D) as int)"))
    rows = rows.withColumn("block", F.expr("cast(pmod(xxhash64(word), blocks) as int)")).withColumn("with", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("longer", "side", "gram", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "word", "n", "block")
    key = ["longer", "side", "gram", "one", "two"]
    # a fixed number of tasks: rows are small and their work is not, so partitions must not be joined by their bytes
    n = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), words.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.repartition(n, *key).sortWithinPartitions(*key, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple[str, int, str, int]] = []
        for (longer, end, _, one, two), group in groupby(stream, key=lambda r: r[:5]):
            members = [r[5:] for r in group]
            for j, k in members_near(members, longer, end, one != two):
                a, b = members[j], members[k]
                out += [(a[0], a[1], b[0], b[1]), (b[0], b[1], a[0], a[1])]
            if len(out) >= 50_000:
                yield told(out)
                out = []
        yield told(out)

    def told(out: list[tuple[str, int, str, int]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "other", "other_n"])

    return arrow_map(dealt, run, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of forms (word, form) of each word ends. Each round doubles the step; n grows with each form, so chains end."""
    known = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = materialise(known.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a table (word, n) of distinct words."""
    words = materialise(words.select("word", "n"), "words")
    pairs = near_pairs(words, block)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"), F.max("n").alias("n"))
    best = best.select("word", "n_near", F.when(-F.col("b.m") >= ratio * F.col("n"), F.struct(F.col("b.other").alias("form"), (-F.col("b.m")).alias("form_n"))).alias("f")).select("word", "n_near", "f.form", "f.form_n")
    best = materialise(best, "forms")
    ends = roots(best.where("form is not null"))
    rows = words.join(best, "word", "left").join(ends, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, after the planted slips."""
    return variant_groups(word_counts(table(spark, sf_dir, "documents"), change=typos))
