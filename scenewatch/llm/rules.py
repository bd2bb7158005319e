"""Quality rules as a learned decision list: sequential covering over statistics of each text, applied as CASE WHEN.

Everything runs in DataFrame functions. A rule is a conjunction of thresholds with a verdict, keep or reject. At each
step one rule of either verdict is grown on two thirds of a bounded sample of labelled documents, one condition at a
time by information gain, and cut back on the other third; the one with more evidence there joins the list, and the
documents that it covers leave the sample. So a text is judged by the first rule that covers it, and the order decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import cut, need, whole, words, written

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "n_words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "dup_lines_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


def n_repeat_words(h: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; h has a hash for each window.

    Only texts with some repeated window sort theirs: equal neighbours give the places, each covers three words.
    """
    placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = F.arrays_zip(F.slice(placed, 1, F.size(h) - 1).alias("a"), F.slice(placed, 2, F.size(h) - 1).alias("b"))
    twice = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    at = F.flatten(F.transform(twice, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
    covered = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.size(covered)).otherwise(0).cast("long")


def statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep, and each whole text's statistics as longs (null text: all 0).

    n_words, word_chars (code points in words), n_symbols, n_lines and n_dup_lines (lines with a word; those equal to
    an earlier one), n_repeat_words (words in 3-word windows found twice or more), n_upper and n_digits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    one = need(docs, *keep, "text").select(*keep, text.alias("t"), words(F.col("text")).alias("w"))
    one = one.withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    room = F.greatest(F.size("w") - 2, F.lit(0))
    one = one.withColumn("windows", F.arrays_zip(F.slice("w", 1, room).alias("a"), F.slice("w", 2, room).alias("b"), F.slice("w", 3, room).alias("c")))
    one = one.withColumn("h", F.transform("windows", lambda x: F.xxhash64(x["a"], x["b"], x["c"])))

    def count(pattern: str) -> Column:
        return F.regexp_count("t", F.lit(pattern)).cast("long")

    return one.select(
        *keep, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), count(f"[{SYMBOLS}]").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("h")).alias("n_repeat_words"), count("\\p{Lu}").alias("n_upper"), count("[0-9]").alias("n_digits"),
    )


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too few words, or too many of them (in percent) in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Conditions = tuple[Condition, ...]


@dataclass(frozen=True)
class Rule:
    conditions: Conditions
    keep: bool

    def __str__(self) -> str:
        return f"{'keep' if self.keep else 'reject'} if {' and '.join(map(str, self.conditions))}"


def covers(conditions: Conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def keep_expression(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: the verdict of the first rule that covers a text, else keep."""
    out = None
    for rule in rules:
        out = (F.when if out is None else out.when)(covers(rule.conditions), rule.keep)
    return F.lit(True) if out is None else out.otherwise(True)


def thresholds(sample: DataFrame, steps: int) -> dict[str, list[float]]:
    """Quantiles of each feature in each class, so that the rarer one has its own, and the middles between neighbours."""
    shares = F.array(*[F.lit(i / steps) for i in range(steps)])
    rows = sample.groupBy("bad").agg(*[F.percentile_approx(F.expr(e), shares, 10_000).alias(f) for f, e in FEATURES.items()]).collect()
    found = {f: sorted({float(x) for row in rows for x in row[f] or []}) for f in FEATURES}
    return {f: sorted({*ts, *((a + b) / 2 for a, b in zip(ts, ts[1:]))}) for f, ts in found.items()}


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of a condition that leaves p of p0 texts of a class and n of n0 others."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def evidence(p: float, n: float, p0: float, n0: float) -> float:
    """Bits by which knowing the shares of p and n tells their classes better than those of p0 and n0 do."""
    return sum(x * math.log2(x / (p + n) * (p0 + n0) / x0) for x, x0 in ((p, p0), (n, n0)) if x)


def grow(rows: DataFrame, cuts: dict[str, list[float]], longest: int, support: int, keep: bool) -> Conditions:
    """The conditions that greedy gain finds for a class on rows (bad: 0 or 1), each by one small aggregate over all."""
    rule: list[Condition] = []
    own, others = (1 - F.col("bad"), F.col("bad")) if keep else (F.col("bad"), 1 - F.col("bad"))
    while len(rule) < longest:
        bins = [F.struct(F.lit(f).alias("f"), F.expr(f"size(filter(array({', '.join(f'{t!r}D' for t in ts)}), t -> t <= {FEATURES[f]}))").alias("bin")) for f, ts in cuts.items() if ts]
        found = rows.where(covers(tuple(rule))).select(own.alias("own"), others.alias("others"), F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.bin").agg(F.sum("own").alias("p"), F.sum("others").alias("n")).collect()
        counts = {f: {r["bin"]: (r.p, r.n) for r in found if r.f == f} for f in cuts}
        some = next((c for c in counts.values() if c), {})
        p0, n0 = (sum(x[k] for x in some.values()) for k in (0, 1))
        if p0 < support or not n0:
            break
        best = (1e-9, None)
        for f, ts in sorted(cuts.items()):
            for k, t in enumerate(ts):
                p, n = (sum(x[s] for b, x in counts[f].items() if b > k) for s in (0, 1))
                for above, (a, b) in ((True, (p, n)), (False, (p0 - p, n0 - n))):
                    if a >= support and (g := gain(a, b, p0, n0)) > best[0]:
                        best = (g, Condition(f, above, t))
        if best[1] is None or best[1] in rule:
            break
        rule.append(best[1])
    return tuple(rule)


def prune(rows: DataFrame, rule: Conditions, keep: bool) -> tuple[Conditions, float, int, int]:
    """The beginning of rule with the best (p - n) / (p + n) on rows, its evidence there, and the p and n it covers."""
    parts = [(), *(rule[: k + 1] for k in range(len(rule)))]
    row = rows.agg(*[F.coalesce(F.sum(F.when(covers(r), F.col("bad") if y else 1 - F.col("bad"))), F.lit(0)) for r in parts for y in (not keep, keep)]).first()
    (p0, n0), *found = [(row[2 * k], row[2 * k + 1]) for k in range(len(parts))]
    p, n, k = max(((p, n, -k) for k, (p, n) in enumerate(found)), key=lambda x: ((x[0] - x[1]) / max(1, x[0] + x[1]), x[2]))
    return parts[1 - k], evidence(p, n, p0, n0), p, n


def learn(labelled: DataFrame, most_rows: int = 20_000, longest: int = 4, most_rules: int = 12, purer: float = 5.0, support: int = 8, steps: int = 24) -> list[Rule]:
    """An ordered list from statistics with `good` (1 or 0; null rows are left out).

    Learns from at most most_rows labelled rows, those with the least hashes. Without bad or good rows there are no
    rules. A rule may join the list if, of what it covers among the rows held back for pruning, the share of the other
    class is at most 1 / `purer` of what it is among all that are left. What no rule covers is kept, or, where most of
    the labelled rows that are left at the end are bad, rejected by a last rule without conditions.
    """
    row = F.xxhash64(*BASE, *[c for c in ("doc_id",) if c in labelled.columns])
    sample = cut(labelled.where("good is not null").withColumn("_h", row).orderBy("_h").limit(most_rows).withColumn("bad", 1 - F.col("good").cast("int")).coalesce(4))
    cuts = thresholds(sample, steps)
    if not any(cuts.values()):
        return []
    rest, rules = sample, []
    while len(rules) < most_rules:
        growing, pruning = rest.where("pmod(_h, 3) < 2"), rest.where("pmod(_h, 3) = 2")
        base = pruning.agg(F.avg("bad")).first()[0]
        best = (0.0, None)
        for keep in (False, True):
            found = grow(growing, cuts, longest, support, keep)
            if not found or base is None:
                continue
            found, value, p, n = prune(pruning, found, keep)
            pure = n <= (p + n) * (base if keep else 1 - base) / purer
            if pure and p >= max(1, support // 4) and value > best[0]:
                best = (value, Rule(found, keep))
        if best[1] is None:
            break
        rules.append(best[1])
        rest = rest.where(~covers(best[1].conditions))
    bad, all_ = rest.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
    return [*rules, Rule((), False)] if rules and bad >= support and 2 * bad > all_ else rules


def judged(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, statistics, base_failed, kept) for each document; labels has (doc_id, quality 1 or 0).

    kept is false where the base rules fail, else the verdict of the list learned from the labelled documents. Null
    and empty texts have all statistics 0 and fail. Labels of unknown documents, and null ones, count for nothing; of labels of one id the
    greatest counts. Repeated rows give a row each, with one verdict; an empty table gives none.
    """
    stats = written(statistics(docs, "doc_id"), "text-statistics")
    known = need(labels, "doc_id", "quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("good"))
    rules = learn(stats.where("doc_id is not null").join(known, "doc_id").where(~base_failed()), **options)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & keep_expression(rules))


def where_once(stats: DataFrame, condition: Column) -> DataFrame:
    """stats.where(condition), with each statistic computed once a row.

    The optimizer would move the condition below the statistics and compute each again for every place that names it;
    it leaves a condition above a column that is not deterministic where it is.
    """
    return stats.withColumn("_row", F.monotonically_increasing_id()).where((F.col("_row") >= 0) & condition).drop("_row")


def passing(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, **options) -> DataFrame:
    """The documents, with all their columns, that base rules and the learned list keep.

    Learns from at most most_rows labelled documents, those with the least hashed ids. Null and empty texts fail the base rules; a null
    doc_id is judged by its text and never learned from; each of repeated rows is judged alone and alike; of labels of one id the
    greatest counts. An empty table gives no rows; without labels the base rules alone decide.
    """
    known = need(labels, "doc_id", "quality").where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))
    sample = need(docs, "doc_id", "text").join(chosen, "doc_id")
    rules = learn(where_once(statistics(sample, "doc_id", "good"), ~base_failed()), most_rows, **options)
    return where_once(statistics(whole(docs, "text"), "_doc"), ~base_failed() & keep_expression(rules)).select("_doc.*")
