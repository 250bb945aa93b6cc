"""Quality rules learned as an ordered decision list, applied as one Spark conditional expression.

Statistics of each text are SQL expressions. Sequential covering learns on the driver from the statistics of a bounded
sample of labelled documents (``MAX_LABELLED`` rows, taken by a hash of doc_id): each rule grows by the
threshold that gains most information on one part, is pruned on another, and is kept only if it is precise enough;
the rows it covers leave, and the next rule starts. The list becomes ``CASE WHEN rule 1 ... WHEN rule 2 ...``.
All documents are then judged in one scan, without a shuffle.

Rules have four conditions and a list twelve rules at most (parameters of ``learn``); a threshold is one of all midpoints between neighbouring values, so a growing step
looks at each of them.

Null text: no words, so the base rule rejects it; a long text is one row of one task. Rows that repeat are judged each by its own text, a null doc_id stays null, an empty table gives no
rows and other columns, whatever their names, are kept by the stage. A document without a label is judged like any other;
labels that repeat a doc_id count as their lowest quality. Without labels the list is empty and only the base rule rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import let, table

#: Labelled rows that the list is learned from, at most.
MAX_LABELLED = 20_000
SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Statistics that rules may test.
FEATURES = ("symbol_share", "exclaim_share", "upper_share", "repeat_share", "dup_line_share", "distinct_share", "mean_word", "digit_share")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Word, symbol, line and window counts of each text, and the shares that rules test; the columns in ``carry`` stay, in the struct _row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), *row)
    # texts that repeat a window: sort windows with their places, keep equal neighbours, sum what they cover
    equal = "coalesce(get(s, k).h = get(s, k - 1).h, false) or coalesce(get(s, k).h = get(s, k + 1).h, false)"
    places = f"sort_array(transform(filter(sequence(0, size(s) - 1), k -> {equal}), k -> get(s, k).i))"
    covered = let(places, "p", f"aggregate(p, struct(-{WINDOW} as at, 0L as n), (a, x) -> struct(x as at, a.n + least({WINDOW}, x - a.at) as n), a -> a.n)")
    repeats = f"if(size(array_distinct(g)) < size(g), {let('sort_array(transform(g, (h, i) -> struct(h, i)))', 's', covered)}, 0L)"
    windows = f"if(size(h) >= {WINDOW}, transform(sequence(1, size(h) - {WINDOW - 1}), i -> xxhash64(slice(h, i, {WINDOW}))), array())"
    repeated = let("transform(w, x -> xxhash64(x))", "h", let(windows, "g", repeats))
    of_words = f"named_struct('n', size(w), 'chars', aggregate(w, 0L, (a, x) -> a + length(x)), 'distinct', size(array_distinct(w)), 'repeated', {repeated})"
    split = lambda by: f"filter(split(_text, '{by}'), x -> x != '')"
    lines = "filter(split(_text, '\\n'), x -> trim(concat(' \\t\\n', char(11), char(12), '\\r') from x) != '')"
    of_lines = let(lines, "l", "named_struct('n', size(l), 'distinct', size(array_distinct(l)))")
    out = out.withColumn("_m", F.expr(let(split(SPACES.replace("\\", "\\\\")), "w", of_words))).withColumn("_l", F.expr(of_lines))
    out = out.select(
        "doc_id",
        *(["_row"] if carry else []),
        F.col("_m.n").cast("long").alias("n_words"),
        F.col("_m.chars").alias("word_chars"),
        F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.col("_l.n") - F.col("_l.distinct")).cast("long").alias("n_dup_lines"),
        F.col("_m.repeated").cast("long").alias("n_repeat_words"),
        F.col("_l.n").alias("_n_lines"),
        F.col("_m.distinct").alias("_distinct"),
        F.regexp_count("_text", F.lit("!")).alias("_exclaim"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).alias("_upper"),
        F.regexp_count("_text", F.lit("[0-9]")).alias("_digits"),
    )
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return out.withColumns(
        {
            "symbol_share": F.col("n_symbols") / chars,
            "exclaim_share": F.col("_exclaim") / chars,
            "upper_share": F.col("_upper") / chars,
            "digit_share": F.col("_digits") / chars,
            "repeat_share": F.col("n_repeat_words") / words,
            "dup_line_share": F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1)),
            "distinct_share": F.col("_distinct") / words,
            "mean_word": F.col("word_chars") / words,
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    ).drop("_n_lines", "_exclaim", "_upper", "_digits", "_distinct")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # at least the threshold; else at most
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Add the condition of the highest information gain until no good row is covered."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < most:
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p0 or not n0:
            break
        before, best = math.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, values in x.items():
            v, y = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            up = np.concatenate([[0], np.cumsum(y)])
            edges = np.flatnonzero(np.diff(v) > 0) + 1
            for above in (True, False):
                p, total = (up[-1] - up[edges], len(v) - edges) if above else (up[edges], edges)
                gain = p * (np.log2(np.maximum(p, 1) / total) - before)
                if len(edges) and gain.max() > best[0]:
                    e = int(edges[gain.argmax()])
                    best = float(gain.max()), Condition(f, above, float((v[e] + v[e - 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The prefix of conditions with the best (bad - good) share on rows not used to grow it."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - 4 * n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.98, least: int = 3) -> list[Rule]:
    """An ordered list of rules that reject."""
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    split = np.arange(len(bad)) % 3 == 2
    while len(rules) < most_rules and (bad & left).sum() >= least:
        g, p = left & ~split, left & split
        part = lambda m: {f: v[m] for f, v in x.items()}
        rule = grow(part(g), bad[g], most_conditions)
        rule = prune(rule, part(p), bad[p]) if rule else rule
        hit = covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        if not rule or (hit & bad).sum() < least or (hit & bad).sum() < precision * hit.sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that rejects a row; null if none does."""
    out: Column | None = None
    for k, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(k + 1)) if out is None else out.when(test, F.lit(k + 1))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``bound`` labelled documents that pass the base rule."""
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_quality"))
    n = labelled.count()
    share = min(1.0, bound / n) if n else 0.0
    chosen = labelled.where((F.xxhash64("doc_id") / 2.0**64 + 0.5) < share)  # about bound rows of 16 bytes
    rows = measured(docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")).join(F.broadcast(chosen), "doc_id").select("doc_id", "_quality", "base_failed", *FEATURES).collect()
    rows = sorted(r for r in rows if not r["base_failed"])[:bound]  # a filter in the plan would measure all texts before the join
    if not rows:
        return []
    x = {f: np.array([r[f] for r in rows], float) for f in FEATURES}
    return learn(x, np.array([r["_quality"] == 0 for r in rows]))


def judge(docs: DataFrame, rules: list[Rule], carry: tuple[str, ...] = ()) -> DataFrame:
    """Statistics and verdict of each document; ``rule`` tells which rule of the list rejects it."""
    out = measured(docs, carry=carry).withColumn("rule", decision(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document, by rules learned from the labels table."""
    docs = table(spark, sf_dir, "documents")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the list rejects, all columns as they were. Each row is judged by its own text: null ids stay, repeated ids are told apart."""
    out = judge(docs, fit(docs, table(spark, sf_dir, "labels")), tuple(docs.columns))
    return out.where("kept").select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
