"""Substring deduplication by De Bruijn compaction.

Nodes of the graph are token k-mers: of each window of ``span`` consecutive words the least by hash, so every window
has one and equal windows have the same. Edges run from one k-mer of a text to the next and are labelled with
the words from the first to the second. A k-mer is kept if two documents have it. An edge is nonbranching if
all occurrences of its first k-mer go on by it and all of its second come from it; nonbranching edges join on their labels, and pointer doubling by
Spark joins compacts each path of them to its first k-mer. Texts then have one row per path they run through, with
source coordinates: document, place, windows.

All runs through a path share its words. If the words of all windows around it agree too (one variant), the least doc_id decides for the
whole run. Where runs differ at the ends, the path branches: windows inside the path are decided by its least doc_id, the windows that reach over an
end are compared one by one, once for each variant. What counts as a repeat is decided on the input, never on what is left.

Hashes only propose. Before anything is removed, the words at the source coordinates of all that was found equal are
read and compared by their sha256; if any differ, the whole is done again with other hashes.

Joins are on k-mers, labels, paths and windows, whose counts are pre-aggregated; a passage that a third of the corpus shares is
one row per run, never a pair. Texts are shuffled only for documents that have something to remove or compare.

Null text has no words; texts under ``span`` words have no windows. Rows that repeat a doc_id are told apart by their text, rows that repeat whole give equal rows; equal ids are not smaller.
An empty table gives no rows. Long texts are one row of one task. Other columns are not read; the stage keeps them all, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.bpe import U, mix
from tidewatch.llm.common import arrow_map, materialise, parts, table, with_text

SPAN, EDGE = 50, 12
B1, B2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)
OCCURRENCES = "kmer long, back long, ahead long, gap int, cover long, doc_id long, row_key long, at int, first int, n int, n_words long, sha string"
WINDOWS = "w1 long, w2 long, doc_id long, head long, cover long, place int"
#: Bytes of a word up to which whole arrays of words are hashed at once.
SHORT = 64
#: Stands for a null doc_id inside: after all others.
LAST = (1 << 63) - 1
CUT = "doc_id long, row_key long, n_removed long, sha string, text string"
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
#: SQL for the result of the query.
ORACLE = """WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 win AS (SELECT k, doc_id, p, array_to_string(w[p:p + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) t(p)),
 least AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s HAVING min(doc_id) < max(doc_id)),
 gone AS (SELECT DISTINCT k, q FROM win JOIN least USING (s), unnest(range(p, p + 50)) u(q) WHERE doc_id > m),
 word AS (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM d WHERE k IN (SELECT k FROM gone)),
 kept AS (SELECT k, string_agg(x, ' ' ORDER BY q) AS t FROM word ANTI JOIN gone USING (k, q) GROUP BY k),
 n AS (SELECT k, count(*) AS n FROM gone GROUP BY k)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256 FROM d LEFT JOIN n USING (k) LEFT JOIN kept USING (k)"""


def strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the strings, end to end, with eight more, and where each begins and the last ends."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = np.zeros(offsets[-1] - offsets[0] + 8, np.uint8)
    if len(held) > 8:
        held[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return held, offsets - offsets[0]


def word_hashes(words: pa.Array, salt: int = 0) -> np.ndarray:
    """64-bit hashes of words: the length and eight bytes after eight are mixed in, all words at once; long words by xxh3."""
    held, offsets = strings(words)
    sizes, eights = np.diff(offsets), np.ndarray(len(held) - 7, "<u8", held, strides=(1,))
    out = mix(sizes.astype(U) + mix(np.full(1, salt, U) + B1))
    live = np.flatnonzero(sizes <= SHORT)
    for k in range(0, SHORT, 8):
        live = live[sizes[live] > k]
        unused = U(8) * (U(8) - np.minimum(sizes[live] - k, 8).astype(U))
        out[live] = mix(out[live] * B2 + (eights[offsets[live] + k] << unused))
    for i in np.flatnonzero(sizes > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(held[offsets[i] : offsets[i + 1]], salt)
    return mix(out)


class Words:
    """The words of a batch of texts, as hashes in one row, with prefix sums for the hash of any run."""

    def __init__(self, texts: pa.Array, salt: int = 0):
        self.salt = salt
        lists = pc.ascii_split_whitespace(texts)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False).astype(bool)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        self.flat = flat.filter(pa.array(real))
        self.sizes = np.bincount(owner[real], minlength=len(sizes))
        self.ends = np.cumsum(self.sizes)

    @cached_property
    def hashes(self) -> np.ndarray:
        coded = self.flat.dictionary_encode()
        return word_hashes(coded.dictionary, self.salt)[coded.indices.to_numpy()]

    def joined(self, ends: np.ndarray) -> pa.Array:
        """The words up to each of the ends, from the one before on, joined by one space."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), self.flat), " ")

    def runs(self, base: np.uint64, at: np.ndarray, size) -> np.ndarray:
        """The hash of the size words from each place on."""
        n = len(self.hashes)
        inverse = U(pow(int(base), -1, 1 << 64))
        powers, back = np.full(n + 1, base), np.full(n + 1, inverse)
        powers[0] = back[0] = 1
        powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
        sums = np.concatenate([[U(0)], np.add.accumulate(self.hashes * powers[:-1])]) if n else np.zeros(1, U)
        return mix((sums[at + size] - sums[at]) * back[at])


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def occurrences(docs: DataFrame, span: int, edge: int, salt: int) -> DataFrame:
    """One row per k-mer of a text: labels of the edges to it and from it, words to the next one, a hash of all words under its windows,
    source coordinates. And one row without k-mer per document with its words and the digest of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kmer", "back", "ahead", "gap", "cover", "doc_id", "row_key", "at", "first", "n", "n_words", "sha"]
        for batch in parts(batches):
            w = Words(batch.column("text"), salt)
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row_key").to_numpy()
            sha = [hashlib.sha256(x).hexdigest() for x in w.joined(w.ends).cast(pa.large_binary()).to_pylist()]
            m, none, short = len(sha), lambda n: pa.nulls(n, pa.int64()), lambda n: pa.nulls(n, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [none(m), none(m), none(m), short(m), none(m), batch.column("doc_id"), batch.column("row_key"), short(m), short(m), short(m), pa.array(w.sizes, pa.int64()), pa.array(sha)], names
            )
            total = len(w.hashes)
            if total < span:
                continue
            kmers = w.runs(B1, np.arange(total - edge + 1), edge)
            least = np.lib.stride_tricks.sliding_window_view(kmers, span - edge + 1)
            starts = np.arange(total - span + 1)
            least = starts + np.concatenate([least[k : k + 65536].argmin(axis=1) for k in range(0, len(least), 65536)])
            owner = np.repeat(np.arange(m), w.sizes)[starts]
            inside = starts + span <= w.ends[owner]
            starts, least, owner = starts[inside], least[inside], owner[inside]
            if not len(starts):
                continue
            cut = np.flatnonzero(np.concatenate([[True], (np.diff(least) != 0) | (np.diff(owner) != 0)]))
            first, n = starts[cut], np.diff(np.append(cut, len(starts)))
            at, own = least[cut], owner[cut]
            cover = mix(w.runs(B2, first, n + span - 1) + (at - first).astype(U) * B1)
            gap, on = np.diff(at), np.diff(own) == 0  # on: the next k-mer is of the same text
            label = mix(w.runs(B2, at[:-1], gap + edge) + gap.astype(U) * B1).view(np.int64)
            begin = (w.ends - w.sizes)[own]
            k = len(cut)
            yield pa.RecordBatch.from_arrays(
                [
                    signed(kmers[at]), pa.array(np.append(0, label), mask=np.append(True, ~on)), pa.array(np.append(label, 0), mask=np.append(~on, True)), pa.array(np.append(gap, 0), pa.int32(), mask=np.append(~on, True)), signed(cover),
                    pa.array(ids[own], pa.int64()), pa.array(keys[own]), pa.array(at - begin, pa.int32()), pa.array(first - begin, pa.int32()), pa.array(n, pa.int32()), none(k), pa.nulls(k, pa.string()),
                ],
                names,
            )

    return arrow_map(docs, run, OCCURRENCES)


def source(docs: DataFrame) -> DataFrame:
    return with_text(docs).select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))


def prefiltered(spark: SparkSession) -> None:
    """Let Spark put a Bloom filter of a join's small side before the shuffle of its large side."""
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1m")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "1g")


def chosen(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Texts of the documents in ranges; other texts stay out of the shuffle where a Bloom filter is worth while."""
    prefiltered(docs.sparkSession)
    return docs.join(ranges.where(F.size("ranges") > 0), ["doc_id", "row_key"])


def windows(texts: DataFrame, span: int, edge: int, salt: int) -> DataFrame:
    """One row per window of the runs in ``ranges`` that reaches over an end of its path; place counts from the path's first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column("text"), salt)
            begin = w.ends - w.sizes
            lists = batch.column("ranges")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            r = {f: lists.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("head", "cover", "start", "reach", "first", "last")}
            n = (r["last"] - r["first"]).astype(np.int64)
            rows = np.repeat(np.arange(len(n)), n)
            place = (r["first"] - r["start"])[rows] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
            over = (place < 0) | (place + span > r["reach"][rows] + edge)
            rows, place = rows[over], place[over]
            at = begin[owner[rows]] + r["start"][rows] + place
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [signed(w.runs(B1, at, span)), signed(w.runs(B2, at, span)), pa.array(ids[owner[rows]]), pa.array(r["head"][rows]), pa.array(r["cover"][rows]), pa.array(place, pa.int32())],
                ["w1", "w2", "doc_id", "head", "cover", "place"],
            )

    return arrow_map(texts, run, WINDOWS)


def compacted(kmers: DataFrame) -> DataFrame:
    """(kmer, head, off) of k-mers that follow on a nonbranching edge: the first k-mer of their path and the words from there."""
    only = lambda c: (F.col(f"{c}_lo") == F.col(f"{c}_hi")) & (F.col(f"{c}_n") == F.col("n"))
    onward = kmers.where(only("ahead")).select(F.col("kmer").alias("head"), F.col("ahead_lo").alias("label"), F.col("gap").alias("off"))
    up = materialise(kmers.where(only("back")).select("kmer", F.col("back_lo").alias("label")).join(onward, "label").select("kmer", "head", "off"), "compacted")
    while True:  # a text ends, so its last k-mer branches: paths have no cycles
        beyond = up.select(F.col("kmer").alias("head"), F.col("head").alias("top"), F.col("off").alias("more"))
        step = up.join(beyond, "head", "left").select("kmer", F.coalesce("top", "head").alias("head"), (F.col("off") + F.coalesce("more", F.lit(0))).alias("off"), F.col("top").isNotNull().alias("moved"))
        step = materialise(step, "compacted")
        up = step.drop("moved")
        if step.where("moved").isEmpty():
            return up


def unequal(docs: DataFrame, claims: DataFrame) -> DataFrame:
    """Keys (k1, k2) whose claims (doc_id, row_key, first, n, but, upto) are not all of the same words, by the sha256 of the words at those coordinates; words from but to upto are left out, as another claim has them."""
    quarters = [f"s{k}" for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column("text"))
            shown = memoryview(w.joined(np.array([len(w.flat)]))[0].as_buffer())
            at = strings(w.flat)[1] + np.arange(len(w.flat) + 1)  # where each word begins in them
            lists = batch.column("ranges")
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            r = {f: lists.flatten().field(f) for f in ("k1", "k2", "first", "n", "but", "upto")}
            whole = r["but"].is_null().to_numpy(zero_copy_only=False)
            first, n, but, upto = (r[f].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "n", "but", "upto"))
            last, begin = first + n, (w.ends - w.sizes)[owner]
            # two stretches of words, the second for claims with words left out
            words = [first, np.where(whole, last, np.maximum(first, but)), np.minimum(last, upto), last]
            a, b, c, d = (at[begin + np.minimum(x, w.sizes[owner])] for x in words)
            rows = zip(a.tolist(), np.maximum(a, b - 1).tolist(), c.tolist(), np.maximum(c, d - 1).tolist(), whole.tolist(), strict=True)
            digests = b"".join([hashlib.sha256(shown[a:b] if w else b"  ".join((shown[a:b], shown[c:d]))).digest() for a, b, c, d, w in rows])
            digests = np.frombuffer(digests, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([r["k1"], r["k2"], *(pa.array(x) for x in digests.T)], ["k1", "k2", *quarters])

    by_text = materialise(claims.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("k1", "k2", "first", "n", "but", "upto")).alias("ranges")), "claims")
    shown = arrow_map(chosen(docs, by_text), run, "k1 long, k2 long, " + ", ".join(f"{c} long" for c in quarters))
    ends = shown.groupBy("k1", "k2").agg(*[x for c in quarters for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))])
    return ends.where(" or ".join(f"{c}_lo < {c}_hi" for c in quarters)).select("k1", "k2")


def repeats(docs: DataFrame, span: int = SPAN, edge: int = EDGE, salt: int = 0) -> tuple[DataFrame, DataFrame]:
    """All documents with their word counts and digests, and (doc_id, row_key, ranges) of those with windows that start in a smaller doc_id."""
    base = source(docs)
    table_ = materialise(occurrences(base, span, edge, salt), "kmers")
    every = table_.where("kmer is null").select("doc_id", "row_key", "n_words", "sha")
    every_kmer = table_.where("kmer is not null")
    prefiltered(docs.sparkSession)
    shared = every_kmer.groupBy("kmer").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    shared = materialise(shared.where("least < most"), "shared")
    met_kmers = materialise(every_kmer.join(shared.where("least < most").select("kmer"), "kmer").drop("n_words", "sha"), "repeated")
    ends = [x for c in ("back", "ahead") for x in (F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.count(c).alias(f"{c}_n"))]
    kmers = materialise(met_kmers.groupBy("kmer").agg(F.count("*").alias("n"), F.min("gap").alias("gap"), *ends), "nodes")
    place = kmers.select("kmer").join(compacted(kmers), "kmer", "left").select("kmer", F.coalesce("head", "kmer").alias("head"), F.coalesce("off", F.lit(0)).alias("off"))
    found = met_kmers.join(materialise(place, "places"), "kmer")
    runs = found.groupBy("head", "doc_id", "row_key", (F.col("at") - F.col("off")).alias("start")).agg(
        F.min("first").alias("first"), F.max(F.col("first") + F.col("n")).alias("last"), F.max("off").alias("reach"), F.bit_xor(F.xxhash64("cover", "off")).alias("cover")
    )
    runs = materialise(runs, "runs")
    columns = ["doc_id", "row_key", "start", "first", "last", "reach"]
    # one variant for each different surrounding of a path; its first source stands for it
    variants = runs.groupBy("head", "cover").agg(F.min(F.struct(*columns)).alias("v"), (F.min("doc_id") < F.max("doc_id")).alias("many"))
    variants = materialise(variants, "variants")
    path = materialise(variants.groupBy("head").agg(F.min("v.doc_id").alias("least"), (F.count("*") > 1).alias("branches")), "paths")
    variants = materialise(variants.join(path, "head"), "variants")
    held = materialise(runs.join(variants.where("branches or many"), ["head", "cover"]), "held")
    inner = F.col("reach") + edge - span + 1  # windows inside the path
    reps = variants.where("branches").select("head", "cover", "least", "v.*")
    wanted = reps.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("head", "cover", "start", "reach", "first", "last")).alias("ranges"))
    shown = materialise(windows(chosen(base, materialise(wanted, "wanted")).dropDuplicates(["doc_id", "row_key"]), span, edge, salt), "windows")
    common = materialise(shown.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"), "common")
    met = materialise(shown.join(common.where("least < most").drop("most"), ["w1", "w2"]), "met")
    whole = [F.lit(None).cast("int").alias("but"), F.lit(None).cast("int").alias("upto")]
    claims = [
        held.where("many").select("doc_id", "row_key", F.col("head").alias("k1"), F.col("cover").alias("k2"), "first", (F.col("last") - F.col("first") + span - 1).alias("n"), *whole),
        reps.select("doc_id", "row_key", F.col("head").alias("k1"), F.lit(0).cast("long").alias("k2"), F.col("start").alias("first"), (F.col("reach") + edge).alias("n"), *whole),
        met.join(reps.select("head", "cover", "row_key", "start", "reach"), ["head", "cover"]).select(
            "doc_id", "row_key", F.col("w1").alias("k1"), F.col("w2").alias("k2"), (F.col("start") + F.col("place")).alias("first"), F.lit(span).alias("n"), F.col("start").alias("but"), (F.col("start") + F.col("reach") + edge).alias("upto")
        ),
    ]
    if not materialise(unequal(base, claims[0].union(claims[1]).union(claims[2])), "unequal").isEmpty():
        return repeats(docs, span, edge, salt + 1)
    later = held.where("doc_id > v.doc_id").select("doc_id", "row_key", "first", (F.col("last") - F.col("first")).alias("n"))
    own = held.where("doc_id = v.doc_id and branches")
    within = own.where((F.col("doc_id") > F.col("least")) & (inner > 0)).select("doc_id", "row_key", F.col("start").alias("first"), inner.alias("n"))
    places = met.where("doc_id > least").groupBy("head", "cover").agg(F.collect_set("place").alias("places"))  # under span at each end
    single = own.join(materialise(places, "single"), ["head", "cover"]).select("doc_id", "row_key", "start", F.explode("places").alias("p")).select("doc_id", "row_key", (F.col("start") + F.col("p")).alias("first"), F.lit(1).alias("n"))
    ranges = later.union(within).union(single).groupBy("doc_id", "row_key").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))
    return every, materialise(ranges, "ranges")


def cut(docs: DataFrame, ranges: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents with ranges: words removed, digest of those kept, and the text without them, its white space as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, key, text, rs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row_key", "text", "ranges")), strict=True):
                words = re.findall(r"([^ \t-\r]+)([ \t-\r]*)", text)
                marks = np.zeros(len(words) + 1, np.int64)
                np.add.at(marks, [r["first"] for r in rs], 1)
                np.add.at(marks, [min(len(words), r["first"] + r["n"] + span - 1) for r in rs], -1)
                kept = [w for w, c in zip(words, np.cumsum(marks[:-1]).tolist(), strict=True) if not c]
                rows.append((doc, key, len(words) - len(kept), hashlib.sha256(" ".join([w for w, _ in kept]).encode()).hexdigest(), "".join([w + s for w, s in kept])))
            cols = zip(*rows, strict=True) if rows else ((),) * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "row_key", "n_removed", "sha", "text"])

    return arrow_map(chosen(source(docs), ranges), run, CUT)


def deduplicate(docs: DataFrame, span: int = SPAN, edge: int = EDGE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""
    every, ranges = repeats(docs, span, edge)
    changed = cut(docs, ranges, span).drop("text").dropDuplicates(["doc_id", "row_key"])
    out = every.join(changed.withColumnRenamed("sha", "kept"), ["doc_id", "row_key"], "left")
    return out.select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256")
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that no smaller doc_id's window covers."""
    return deduplicate(table(spark, sf_dir, "documents"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; those with no word left go. Columns stay, whatever their names; n_chars follows the text.
    Rows are found again by doc_id and text, so null and repeated ids and repeated rows keep their own columns."""
    _, ranges = repeats(docs)
    changed = cut(docs, ranges).dropDuplicates(["doc_id", "row_key"]).select(F.struct("doc_id", "row_key").alias("key"), F.struct("text").alias("new"))
    rows = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_key")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(changed, "key", "left").where("new is null or new.text != ''")
    own = {c: F.col("row").getField(c) for c in docs.columns}
    own["text"] = F.when(F.col("new").isNull(), own["text"]).otherwise(F.col("new.text"))
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("new").isNull(), own["n_chars"]).otherwise(F.length("new.text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[c.alias(k) for k, c in own.items()])
