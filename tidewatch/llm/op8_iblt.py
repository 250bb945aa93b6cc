"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs, and long ones into runs of ``RUN`` words; the distinct digests of these
go into two sketches of three subtables of cells, 3 x 4 and 3 x 32, each cell holding how many digests fell in, their xor, and the xor of
their check hashes. The fingerprint is the number of digests and these cells, of one length for all texts. Fingerprints of two versions subtract cell by cell: what both have cancels. Peeling then recovers what differs: a
cell with one digest (its check agrees) gives it up, it leaves its other cells, and so on until all are
empty. The small sketch is tried first, then the large one, which gives up some 75 digests. If cells stay, the pair is sketched again, larger: digests are dealt to as many groups of cells as
their number needs, and a group that still fails is sketched with twice the cells under other hashes, then with four times those; digests that no such sketch gives up are
compared as sets, so the difference is always exact. Two columns tell which likenesses come from the fingerprints alone. Likeness is
the Jaccard share that the recovered difference leaves: (union - difference) / union; two texts without paragraphs are alike.

All of it is SQL expressions. The next document in descending doc_id is found over ids alone: range
partitions are numbered, each orders its own ids, and only their first ids meet. A text travels once to its own
row, and the head of the next text once to that row.

Null text is empty; a null doc_id comes last. An empty table gives no rows; other columns are not read. A long text is one row of one task. Rows that repeat a doc_id are ordered by a hash of their text; equal
rows share one place in that order. The last is followed by the first, so a single row follows itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import let, materialise, table, with_text

#: Words of a run; digests that a group of cells should hold on average.
RUN, LOAD = 16, 3
#: Bits of a cell's number in the small and in the large sketch of a fingerprint; rounds of peeling.
SMALL, LARGE, ROUNDS = 2, 5, 20
FIRST = -(1 << 63)


def digests(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs."""
    return f"array_distinct(transform(regexp_extract_all({text}, '(?:[^ \\\\n]+ *){{1,{RUN}}}', 0), p -> xxhash64(p)))"


def cell(x: str, j: str, bits: int, salt: int) -> str:
    """SQL: whether digest x falls into cell j; each subtable has 2^bits cells and reads bits of its own."""
    mask = (1 << bits) - 1
    word = x if not salt else f"xxhash64({x}, {salt})"
    return f"(shiftrightunsigned({word}, {j} div {mask + 1} * {bits}) & {mask}) = {j} % {mask + 1}"


def sketch(keys: str, bits: int, salt: int = 0) -> str:
    """SQL: the cells of an array of digests."""
    body = let(f"filter({keys}, x -> {cell('x', 'j', bits, salt)})", "ks", "named_struct('n', size(ks), 'k', aggregate(ks, 0L, (a, x) -> a ^ x), 'c', aggregate(ks, 0L, (a, x) -> a ^ xxhash64(x, 7)))")
    return f"transform(sequence(0, {3 * (1 << bits) - 1}), j -> {body})"


def minus(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (s, t) -> named_struct('n', s.n - t.n, 'k', s.k ^ t.k, 'c', s.c ^ t.c))"


def peel(cells: str, bits: int, salt: int, rounds: str) -> str:
    """SQL: how many digests peeling recovers, one a round, or null if cells are left."""
    alone = "get(filter(s.cells, x -> abs(x.n) = 1 and x.c = xxhash64(x.k, 7)), 0)"
    gone = f"transform(s.cells, (x, j) -> if({cell('one.k', 'j', bits, salt)}, named_struct('n', x.n - one.n, 'k', x.k ^ one.k, 'c', x.c ^ one.c), x))"
    step = let(alone, "one", f"if(one is null, s, named_struct('cells', {gone}, 'found', s.found + 1))")
    end = "if(exists(s.cells, x -> x.n != 0 or x.k != 0), null, s.found)"
    return f"aggregate(sequence(1, {rounds}), named_struct('cells', {cells}, 'found', 0), (s, i) -> {step}, s -> {end})"


def differing(u: str, v: str, bits: int, salt: int) -> str:
    """SQL: differing digests by sketches; no more can come out than went in, which bounds the rounds."""
    return peel(minus(sketch(u, bits, salt), sketch(v, bits, salt)), bits, salt, f"size({u}) + size({v})")


def group(u: str, v: str) -> str:
    """SQL: differing digests of one group: larger sketches on failure, at last both sets."""
    as_sets = "size(array_except(u, v)) + size(array_except(v, u))"
    tries = ", ".join(differing("u", "v", bits, salt) for bits, salt in ((2, 0), (3, 11), (5, 13)))
    return let(u, "u", let(v, "v", f"if(size(u) = 0 or size(v) = 0, size(u) + size(v), coalesce({tries}, {as_sets}))"))


def difference(u: str, v: str) -> str:
    """SQL: differing digests of two texts, dealt to groups by two steps of hashing so that no step looks at all digests often."""
    side = let(f"cast(ceil(sqrt((size({u}) + size({v})) / {LOAD}.0D)) as int)", "w", "greatest(w, 1)")
    inner = f"transform(sequence(0, g - 1), b -> {group('filter(ua, x -> pmod(shiftright(x, 36), g) = b)', 'filter(va, x -> pmod(shiftright(x, 36), g) = b)')})"
    outer = let(f"filter({u}, x -> pmod(shiftright(x, 18), g) = a)", "ua", let(f"filter({v}, x -> pmod(shiftright(x, 18), g) = a)", "va", f"aggregate({inner}, 0, (t, n) -> t + n)"))
    return let(side, "g", f"aggregate(transform(sequence(0, g - 1), a -> {outer}), 0, (t, n) -> t + n)")


def placed(x: str, bits: int, shift: int, more: str = "") -> str:
    """SQL: a digest with its check and the three cells that it falls into, one in each subtable of 2^bits cells, by bits of its own from ``shift`` on."""
    cells = ", ".join(f"'p{t}', cast({t << bits} + (shiftrightunsigned({x}, {shift + t * bits}) & {(1 << bits) - 1}) as int)" for t in range(3))
    return f"named_struct('k', {x}, 'c', {check(x)}, {cells}{more})"


def check(x: str) -> str:
    return f"(xxhash64({x}, 7) & {(1 << 32) - 1})"


def shown_cells(keys: str, bits: int, shift: int) -> str:
    """SQL: cells of the fingerprint: counts modulo 2^16, xor of digests, xor of 32-bit checks."""
    body = "named_struct('n', size(f) & 65535, 'k', aggregate(f, 0L, (a, p) -> a ^ p.k), 'c', aggregate(f, 0L, (a, p) -> a ^ p.c))"
    tables = ", ".join(f"transform(sequence({t << bits}, {(t + 1 << bits) - 1}), j -> {let(f'filter(ks, p -> p.p{t} = j)', 'f', body)})" for t in range(3))
    return let(f"transform({keys}, x -> {placed('x', bits, shift)})", "ks", f"concat({tables})")


def printed(keys: str) -> str:
    """SQL: the fingerprint of an array of digests as it is held: its count and both sketches."""
    return f"named_struct('m', size({keys}), 's', {shown_cells(keys, SMALL, 0)}, 'l', {shown_cells(keys, LARGE, 3 * SMALL)})"


def less(a: str, b: str) -> str:
    """SQL: cells of one text less those of another."""
    return f"zip_with({a}, {b}, (s, t) -> named_struct('n', (s.n - t.n + 98304) % 65536 - 32768, 'k', s.k ^ t.k, 'c', s.c ^ t.c))"


def peeled(cells: str, bits: int, shift: int) -> str:
    """SQL: how many digests peeling recovers from the difference of two sketches, or null if cells are left. Each round takes the digests of all cells that hold one."""
    alone = f"transform(array_distinct(filter(s.cells, x -> (x.n = 1 or x.n = -1) and x.c = {check('x.k')})), y -> {placed('y.k', bits, shift, ", 'n', y.n")})"
    gone = let("filter(ones, o -> o.p0 = j or o.p1 = j or o.p2 = j)", "f", "if(size(f) = 0, x, named_struct('n', x.n - aggregate(f, 0, (a, o) -> a + o.n), 'k', x.k ^ aggregate(f, 0L, (a, o) -> a ^ o.k), 'c', x.c ^ aggregate(f, 0L, (a, o) -> a ^ o.c)))")
    step = f"if(s.done, s, {let(alone, 'ones', f"if(size(ones) = 0, named_struct('cells', s.cells, 'found', s.found, 'done', true), named_struct('cells', transform(s.cells, (x, j) -> {gone}), 'found', s.found + size(ones), 'done', false))")})"
    end = "if(exists(s.cells, x -> x.n != 0 or x.k != 0), null, s.found)"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {cells}, 'found', 0, 'done', false), (s, i) -> {step}, s -> {end})"


def spread(cells: str, bits: int) -> str:
    """SQL: about how many digests differ, by the counts of a difference: each subtable's sum of squares exceeds that number by what the difference of the texts' counts adds."""
    total = f"(aggregate({cells}, 0L, (a, x) -> a + x.n) / 3.0D)"
    return f"((aggregate({cells}, 0L, (a, x) -> a + x.n * x.n) / 3.0D - {total} * {total} / {1 << bits}) / {1 - 1 / (1 << bits)})"


def likeness(u: str, v: str, a: str, b: str) -> str:
    """SQL: Jaccard likeness of two fingerprints a and b by peeling their difference, and whether that was enough; if cells stay, their digests u and v are sketched again, larger, in groups."""
    small = let(less(f"{a}.s", f"{b}.s"), "ds", f"if(abs({a}.m - {b}.m) > {3 << SMALL}, null, {peeled('ds', SMALL, 0)})")
    large = let(less(f"{a}.l", f"{b}.l"), "dl", f"if(abs({a}.m - {b}.m) > {3 << LARGE} or {spread('dl', LARGE)} > {int(0.85 * (3 << LARGE))}, null, {peeled('dl', LARGE, 3 * SMALL)})")
    share = lambda d: f"if({a}.m + {b}.m = 0, 1.0D, ({a}.m + {b}.m - {d}) / double({a}.m + {b}.m + {d}))"
    return let(f"coalesce({small}, {large})", "d0", f"named_struct('near', {let(f'coalesce(d0, {difference(u, v)})', 'd1', share('d1'))}, 'own', d0 is not null)")


def shown(f: str) -> str:
    """SQL: a fingerprint as text: its count in 8 hexadecimal digits, then 28 for each cell of both sketches."""
    return f"concat(lpad(hex({f}.m), 8, '0'), array_join(transform(concat({f}.s, {f}.l), c -> concat(lpad(hex(c.n), 4, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c), 8, '0'))), ''))"


def following(keys: DataFrame) -> DataFrame:
    """For each (doc_id, row_key): the next and the previous in descending order, and the previous one's n_chars."""
    spark = keys.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = [F.col("doc_id").desc(), F.col("row_key").desc()]
    dealt = materialise(keys.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "order")
    me = F.struct("doc_id", "row_key", "n_chars")
    # one row per range partition: its first and last, and those of its neighbours
    ends = dealt.groupBy("part").agg(F.max(me).alias("first"), F.min(me).alias("last"))
    by_part = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(by_part), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(by_part), F.last("last").over(whole)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    linked = dealt.withColumns({"down": F.lead(me).over(inside), "up": F.lag(me).over(inside)}).join(F.broadcast(ends), "part")
    linked = linked.select("doc_id", "row_key", F.coalesce("down", "after").alias("next"), F.coalesce("up", "before").alias("previous"))
    return linked.select("doc_id", "row_key", F.col("previous.doc_id").alias("to_id"), F.col("previous.row_key").alias("to_key"), F.expr("cast(previous.n_chars div 3 as int)").alias("head_chars"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and whether the fingerprints alone gave these two) of each document."""
    base = with_text(docs).select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc_id"), "text", F.xxhash64("text").alias("row_key"))
    keys = base.groupBy("doc_id", "row_key").agg(F.max(F.length("text")).alias("n_chars"))
    own = base.join(following(keys), ["doc_id", "row_key"]).withColumn("units", F.expr(digests("text")))
    heads = own.select(F.col("to_id").alias("doc_id"), F.col("to_key").alias("row_key"), F.substring("text", F.lit(1), F.col("head_chars")).alias("head"), F.col("units").alias("next_units"))
    heads = heads.groupBy("doc_id", "row_key").agg(F.max(F.struct("head", "next_units")).alias("h"))  # equal rows send equal heads
    both = own.select("doc_id", "row_key", "text", "units").join(heads, ["doc_id", "row_key"])
    both = both.select("doc_id", F.length("text").cast("long").alias("n_chars"), "units", F.col("h.next_units").alias("next_units"), F.expr("concat(substring(text, 1, length(text) - length(text) div 3), h.head)").alias("edited"))
    both = both.withColumn("edited_units", F.expr(digests("edited")))
    pairs = f"named_struct('a', {shown('fu')}, 'b', {shown('fe')}, 'x', {likeness('units', 'edited_units', 'fu', 'fe')}, 'y', {likeness('units', 'next_units', 'fu', 'fn')})"
    result = let(printed("units"), "fu", let(printed("edited_units"), "fe", let(printed("next_units"), "fn", pairs)))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.expr(let("units", "units", let("edited_units", "edited_units", let("next_units", "next_units", result)))).alias("r"))
    return both.select(
        F.when(F.col("doc_id") != FIRST, F.col("doc_id")).alias("doc_id"), "n_chars", "edited_sha256",
        F.col("r.a").alias("fingerprint"), F.col("r.b").alias("edited_fingerprint"), F.col("r.x.near").alias("near_edited"), F.col("r.y.near").alias("near_next"),
        F.col("r.x.own").alias("edited_by_fingerprint"), F.col("r.y.own").alias("next_by_fingerprint"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and what differs by them."""
    return fingerprints(table(spark, sf_dir, "documents"))
