"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

A document is the multiset of its runs of ``SHINGLE`` words. Each distinct run carries Poisson processes over
dyadic ranges of discretised weight, [0, 1), [1, 2), [2, 4) and so on; a point has a time, a weight cell and a
signature component, and counts if its cell lies under the run's multiplicity. The earliest point of each component is
the signature; two signatures agree in a component with the weighted Jaccard similarity as probability. Points
are drawn up to a time by which all components are met; texts where one is not go on to a later time.

Two documents are similar if they have at least 0.8 of the runs of the larger one in common, as multisets. All pairs of weighted
Jaccard similarity 0.8 are among them, and so are copies with a few words edited: an edit changes up to five runs of both sides.

Exact copies are one node from the start: their words, joined, agree in a hash of 128 bits. Nodes that share a band meet through a pivot of the band (a star, never all pairs);
pairs whose signatures agree too little to be similar go, the others are verified on their texts, and
verified links join classes. Rounds with other pivots follow in bands that are still hot, only between nodes whose classes still
differ; what is left of those goes by narrower keys. Last, all pairs of different classes that are left in a band are compared by their signatures, in blocks
of bounded size, and members that agree with one of another class are verified in blocks of their texts; only links leave a task. A class that
fills a block meets the blocks of other classes, never its own. Classes are connected components, found by label propagation with pointer jumping in tables.

An overlap of 0.8 means a weighted Jaccard similarity of 2/3 at least; with three rows a band and 32 bands such a pair is missed with probability
1.4e-5, and the filter on signatures loses one with 2e-5.
Texts of one to four words are one run. Null text and texts without words are near to nothing: each is its own class.
Rows that repeat a doc_id are told apart by their text; rows that repeat whole are in one class. A null doc_id comes after all others, so it names a class only where
no other id can. An empty table gives no rows. Long texts are one row of one task. Other columns are not read; the stage keeps them all, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.bpe import U, mix
from tidewatch.llm.common import arrow_map, materialise, parts, table
from tidewatch.llm.op2_substring import B1, B2, LAST, Words, chosen, source

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS = 3, 32
SIZE = ROWS * BANDS
#: Components of 96 that a pair at the threshold agrees in at least, but for two pairs in 10^5.
AGREE = 45
#: Nodes of a band that one task compares with each other; a larger band is dealt in blocks of this size.
BLOCK = 1000
#: Members from which a band takes more star rounds, and then narrower keys: from there on these are fewer rows than blocks would be.
HOT = 50 * BLOCK
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
SIGNED = "doc_id long, row_key long, node long, other long, bands array<long>, sig binary"


def bags(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of the batch's texts: text, run hash, multiplicity."""
    n = w.sizes
    begin = w.ends - n
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), count)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n[owner], SHINGLE)
    runs = w.runs(B1, at, size) if len(at) else np.zeros(0, U)
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(owner) != 0) | (runs[1:] != runs[:-1])])) if len(runs) else np.zeros(0, np.int64)
    return owner[cut], runs[cut], np.diff(np.append(cut, len(runs)))


def signatures(owner: np.ndarray, runs: np.ndarray, weight: np.ndarray, texts: int, size: int = SIZE) -> np.ndarray:
    """BagMinHash signatures of the texts (a row each); zeros where a text has no runs."""
    out = np.zeros((texts, size), U)
    total = np.bincount(owner, weight, texts)
    # one process per run and dyadic range below its weight
    top = np.frexp(np.maximum(weight - 1, 0).astype(float))[1]  # ranges above the first
    reps = top + 1
    level = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
    own, seed, w = np.repeat(owner, reps), mix(np.repeat(runs, reps) + level.astype(U) * B2), np.repeat(weight, reps)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    open_, spread = total > 0, np.log(size) + 6.0
    while open_.any():
        until = np.where(open_, size * spread / np.maximum(total, 1), 0.0)
        best = np.full(texts * size, np.inf)
        value = np.zeros(texts * size, U)
        live = np.flatnonzero(open_[own])
        time, n = np.zeros(len(live)), 0
        while len(live):
            n += 1
            h = mix(seed[live] + U(n * int(B1) & (1 << 64) - 1))
            time = time + -np.log1p(-((h >> U(11)).astype(float) * 2.0**-53)) / width[live]
            on = time <= until[own[live]]
            live, time, h = live[on], time[on], h[on]
            g = mix(h ^ B2)
            under = low[live] + ((g >> U(32)).astype(np.int64) * width[live] >> 32) < w[live]
            place = own[live[under]] * size + (g[under] % U(size)).astype(np.int64)
            np.minimum.at(best, place, time[under])
            won = time[under] == best[place]
            value[place[won]] = h[under][won]
        full = np.isfinite(best).reshape(texts, size).all(axis=1)
        done = open_ & full
        out[done] = value.reshape(texts, size)[done]
        open_ &= ~full
        spread *= 2
    return out


def copies(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit hash of each text's words, joined by spaces. It isn't linear in the words: sums over places, as for runs, can agree for long unlike texts under any base."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], w.ends]), pa.int32()), w.flat), " ")
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in joined.to_pylist()), U).reshape(-1, 2)
    return digests[:, 0].copy(), digests[:, 1].copy()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, node, other, bands, sig) of each document: node and other are two hashes of its words; no bands where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            w = Words(batch.column("text"))
            owner, runs, weight = bags(w)
            whole, other = copies(w)
            sig = signatures(owner, runs, weight, batch.num_rows)
            powers = np.array([pow(int(B1), k, 1 << 64) for k in range(ROWS)], U)
            keys = mix((sig.reshape(-1, BANDS, ROWS) * powers).sum(axis=2, dtype=U) + np.arange(BANDS, dtype=U) * B2)
            some = w.sizes > 0
            keys = keys[some].view(np.int64)
            ends = np.cumsum(np.where(some, BANDS, 0))
            small = (sig >> U(17)).astype(np.uint8)
            # texts without words are nodes of their own
            ids, rows = (batch.column(c).to_numpy().view(U) for c in ("doc_id", "row_key"))
            node = np.where(some, whole, mix(ids * B1 + rows * B2)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row_key"), pa.array(node), pa.array(other.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(keys.ravel())), pa.array([x.tobytes() for x in small], pa.binary())],
                ["doc_id", "row_key", "node", "other", "bands", "sig"],
            )

    return arrow_map(docs, run, SIGNED)


def agreeing(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose signatures agree in enough components."""
    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, SIZE) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    return arrow_map(both.select("a", "b", "sig_a", "sig_b"), run, "a long, b long")


def in_blocks(rows: DataFrame, weight: str) -> DataFrame:
    """Deal the rows (key, node, comp) of each key in blocks of bounded weight; each pair of blocks (i, j) of a key meets in one group.
    A class that fills a block has blocks of its own, which don't meet each other: a large class is repeated for the blocks of the other classes only."""
    held = materialise(rows.groupBy("key", "comp").agg(F.sum(weight).alias("w")), "held").withColumn("n", F.when(F.col("w") >= 1, F.ceil("w").cast("int")))
    before = Window.partitionBy("key").orderBy("comp").rowsBetween(Window.unboundedPreceding, -1)
    large = held.where("n is not null").withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    spans = large.groupBy("key").agg(F.sum("n").cast("int").alias("large"), F.map_from_entries(F.collect_list(F.struct("comp", F.struct("first", "n").alias("span")))).alias("spans"))
    small = held.groupBy("key").agg(F.ceil(F.sum(F.when(F.col("n").isNull(), F.col("w")).otherwise(0.0))).cast("int").alias("small"))
    sizes = materialise(small.join(spans, "key", "left").withColumn("large", F.coalesce("large", F.lit(0))), "sizes")
    dealt = rows.join(sizes, "key").withColumn("span", F.try_element_at("spans", F.col("comp")))
    turn = F.xxhash64("node", F.lit(5))
    mine = F.when(F.col("span").isNull(), F.pmod(turn, F.col("small"))).otherwise(F.col("small") + F.col("span.first") + F.pmod(turn, F.col("span.n")))
    dealt = dealt.withColumn("own", mine.cast("int"))
    others = F.expr("filter(sequence(0, small + large - 1), x -> span is null or x < small + span.first or x >= small + span.first + span.n)")
    dealt = dealt.withColumn("other", F.explode(others)).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    return dealt.drop("small", "large", "spans", "span", "other", weight)


def hot(left: DataFrame) -> DataFrame:
    """(key) of the bands with more than HOT members."""
    return left.groupBy("key").count().where(F.col("count") > HOT).select("key")


def narrowed(left: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (key, node, comp), those of hot bands under narrower keys: the band and two more components. Of the 46 pairs of components outside the
    band similar texts agree in none with probability 2e-12."""
    keys = materialise(hot(left), "hot")
    if keys.isEmpty():
        return left
    rows = left.join(keys, "key").join(nodes.select("node", "bands", "sig"), "node").withColumn("at", (F.array_position("bands", F.col("key")) - 1) * ROWS)
    pairs = F.expr(f"filter(sequence(0, {SIZE // 2 - 1}), p -> 2 * p + 1 < at or 2 * p >= at + {ROWS})")
    rows = rows.withColumn("p", F.explode(pairs)).select(F.xxhash64("key", "p", F.expr("substring(sig, 2 * p + 1, 2)")).alias("key"), "node", "comp")
    rows = materialise(rows, "narrow")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return materialise(left.join(keys, "key", "left_anti").select("key", "node", "comp").union(rows.join(mixed, "key").select("key", "node", "comp")), "narrowed")


def sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the first and of the second block of a group, and whether they are one."""
    own, i, j = block.column("own").to_numpy(), block.column("i")[0].as_py(), block.column("j")[0].as_py()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def likely_members(left: DataFrame, sigs: DataFrame) -> DataFrame:
    """(key, node) of members of bands whose signature agrees enough with that of a member of another class."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, comp = block.column("node").to_numpy(), block.column("comp").to_numpy()
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint8).reshape(len(node), SIZE)
        first, second, _ = sides(block)
        hit = np.zeros(len(node), bool)
        for r in first.tolist():
            near = second[((sig[second] == sig[r]).sum(axis=1) >= AGREE) & (comp[second] != comp[r])]
            hit[near] = True
            hit[r] |= len(near) > 0
        return pa.table({"key": pa.array(block.column("key").to_numpy()[hit], pa.int64()), "node": pa.array(node[hit], pa.int64())})

    dealt = in_blocks(left.withColumn("w", F.lit(1.0 / BLOCK)), "w").select("key", "i", "j", "own", "node", "comp").join(sigs.select("node", "sig"), "node")
    return dealt.groupBy("key", "i", "j").applyInArrow(run, "key long, node long").distinct()


def links_in_blocks(members: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links (a, b) between members (key, node, comp) of one band; of each group of blocks only a forest that joins the same classes leaves the task."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, comp = block.column("node").to_numpy(), block.column("comp").to_numpy()
        owner, runs, weight = bags(Words(block.column("text").combine_chunks() if isinstance(block.column("text"), pa.ChunkedArray) else block.column("text")))
        # the k-th occurrence of a run is an element of its own: multiset overlap becomes set overlap
        turn = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
        own = np.repeat(owner, weight)
        _, element = np.unique(mix(np.repeat(runs, weight) + turn.astype(U) * B1), return_inverse=True)
        size = np.bincount(own, minlength=len(node))
        order = np.argsort(element, kind="stable")
        held, starts = own[order], np.concatenate([[0], np.cumsum(np.bincount(element))]) if len(element) else np.zeros(1, np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        first, second, same = sides(block)
        allowed = np.zeros(len(node), bool)
        allowed[second] = True
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        a, b = [], []
        for r in first.tolist():
            mine = element[begin[r] : begin[r + 1]]
            counts = starts[mine + 1] - starts[mine]
            total = int(counts.sum())
            at = np.repeat(starts[mine] - (np.cumsum(counts) - counts), counts) + np.arange(total)
            common = np.bincount(held[at], minlength=len(node))
            near = np.flatnonzero(allowed & (common >= threshold * np.maximum(size[r], size) - 1e-9) & (comp != comp[r]) & (common > 0))
            for x in near[near > r].tolist() if same else near.tolist():
                p, q = find(int(comp[r])), find(int(comp[x]))
                if p != q:
                    root[p] = q
                    a.append(node[r])
                    b.append(node[x])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = members.join(texts, "node").withColumn("w", F.greatest(F.lit(1.0 / BLOCK), F.octet_length("text") / BLOCK_BYTES))
    return in_blocks(rows, "w").select("key", "i", "j", "own", "node", "comp", "text").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def similarity(owner: np.ndarray, runs: np.ndarray, weight: np.ndarray, pairs: int) -> np.ndarray:
    """Multiset overlap of texts 2i and 2i + 1: runs in common, of those of the larger one."""
    pair = owner // 2
    order = np.lexsort((owner, runs, pair))
    p, r, w = pair[order], runs[order], weight[order]
    same = np.flatnonzero((p[1:] == p[:-1]) & (r[1:] == r[:-1])) if len(p) else np.zeros(0, np.int64)
    common = np.bincount(p[same], np.minimum(w[same], w[same + 1]), pairs)
    sizes = np.bincount(owner, weight, 2 * pairs).reshape(-1, 2).max(axis=1)
    return common / np.maximum(sizes, 1)


def texts_of_nodes(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of each wanted node, from one of its documents."""
    places = materialise(nodes.join(wanted.distinct(), "node").select("doc_id", "row_key", "node", F.array(F.lit(1)).alias("ranges")), "wanted")
    return materialise(chosen(docs, places).dropDuplicates(["node"]).select("node", "text"), "texts")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose multisets of runs are similar enough, by their texts."""
    texts = texts_of_nodes(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))), nodes, docs)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sides = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
            w = Words(pa.array([t for two in zip(*sides, strict=True) for t in two], pa.string()))
            owner, runs, weight = bags(w)
            yield batch.select(["a", "b"]).filter(pa.array(similarity(owner, runs, weight, batch.num_rows) >= threshold - 1e-12))

    return arrow_map(both.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node in edges (a, b): the least node of its component."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        least = label.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        least = materialise(least, "least")
        # pointer jumping: take the label of the node that the label names
        jumped = least.join(least.select(F.col("node").alias("to"), F.col("to").alias("beyond")), "to", "left").select("node", F.least(F.coalesce("beyond", "to"), "to").alias("comp"), "was")
        label = materialise(jumped, "labels")
        if label.where("comp != was").isEmpty():
            return label.select("node", "comp")


class Classes:
    """Class labels of nodes, joined by verified links round after round."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, threshold: float):
        self.nodes, self.docs, self.threshold = nodes, docs, threshold
        self.label = nodes.select("node", F.col("node").alias("comp"))

    def link(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) and join the classes of those that hold."""
        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        likely = materialise(agreeing(pairs, self.nodes), "likely")
        if not likely.isEmpty():
            self.join(materialise(verified(likely, self.nodes, self.docs, self.threshold), "links"))

    def join(self, links: DataFrame) -> None:
        """Join the classes of linked nodes."""
        if links.isEmpty():
            return
        known = self.label
        ends = links.join(known.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(known.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        merged = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a != b"))
        self.label = materialise(known.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "classes")

    def finish(self, left: DataFrame) -> None:
        """Compare all members (key, node, comp) of one band that are in different classes, in blocks."""
        left = narrowed(left, self.nodes)
        near = materialise(likely_members(left, self.nodes), "near")
        if not near.isEmpty():
            members = near.join(left.select("key", "node", "comp"), ["key", "node"])
            texts = texts_of_nodes(near.select("node"), self.nodes, self.docs)
            self.join(materialise(links_in_blocks(members, texts, self.threshold), "links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, rounds: int = 4) -> DataFrame:
    """(doc_id, row_key, class_id): near-duplicate classes, named by their least doc_id. After the first star round only hot bands take more, up to rounds."""
    base = source(docs)
    rows = materialise(signed(base), "signed")
    first = [F.min(F.struct("doc_id", "row_key", "bands", "sig")).alias("r"), F.min("other").alias("lo"), F.max("other").alias("hi")]
    nodes = materialise(rows.groupBy("node").agg(*first), "nodes")
    if not nodes.where("lo != hi").isEmpty():  # different texts met in one hash: the other one tells them apart
        rows = materialise(rows.withColumn("node", F.xxhash64("node", "other")), "signed")
        nodes = materialise(rows.groupBy("node").agg(*first), "nodes")
    nodes = nodes.select("node", "r.*")
    band = nodes.select("node", F.explode("bands").alias("key"))
    shared = materialise(band.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "bands")
    members = materialise(band.join(shared, "key"), "members")
    held = Classes(nodes, base, threshold)

    def split() -> DataFrame:
        """Members of bands that hold more than one class."""
        now = members.join(held.label, "node")
        mixed = materialise(now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "mixed")
        return materialise(now.join(mixed, "key"), "split")

    left = split()
    for r in range(rounds):
        now = materialise(left.join(hot(left), "key", "left_semi"), "hot") if r else left
        if now.isEmpty():
            break
        pivots = materialise(now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)), "node", "comp")).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.comp").alias("to")), "pivots")
        held.link(now.join(pivots, "key").where("comp != to").select(F.col("node").alias("a"), "b"))
        left = split()
    if not left.isEmpty():
        # what stars have not told: every pair of different classes that shares a band
        held.finish(left)
    found = rows.select("doc_id", "row_key", "node").join(held.label, "node")
    found = materialise(found.select("doc_id", "row_key", "comp"), "found")
    names = materialise(found.groupBy("comp").agg(F.min(F.struct("doc_id", "row_key")).alias("r"), F.count("*").alias("class_size")), "names")
    return found.join(names, "comp").select("doc_id", "row_key", F.col("r.doc_id").alias("class_id"), F.col("r.row_key").alias("class_key"), "class_size")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its near-duplicate class and the size of that."""
    out = classes(table(spark, sf_dir, "documents"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(real("doc_id"), real("class_id"), "class_size")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one of least doc_id; columns stay, whatever their names. Of rows that repeat both doc_id and text the one that
    comes first as JSON stays."""
    found = materialise(classes(docs), "verdicts")
    kept = found.where("doc_id = class_id and row_key = class_key").select(F.struct("doc_id", "row_key").alias("key")).distinct()
    rows = docs.select(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row_key")).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(kept, "key", "left_semi")
    if not found.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():
        out = out.groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
