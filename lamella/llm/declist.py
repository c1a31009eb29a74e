"""Quality rules: a learned decision list over statistics of whole texts, as Spark conditional expressions.

Statistics are DataFrame expressions on each row, without a shuffle: words and their code points, symbols, repeated lines,
words in repeated three-word windows, distinct words, capitals, exclamation marks. Windows are compared by a 64-bit hash
of their words.

Learning is sequential covering on labelled rows (quality 0 is what rules describe). Two thirds of them grow rules, a
third prunes them. A rule grows condition by condition, each the threshold on one statistic with the best gain in
information on what is still covered, until it covers no good row or nothing gains; then its last conditions go
as long as its precision on the pruning rows, smoothed, doesn't fall. It is kept if it is right on PRECISION of the pruning
rows it covers, the rows it covers are set aside, and the next rule grows on the rest. Thresholds are quantiles of the
growing rows. Rows are bits of integers, so that a rule's cover is an `and`. The list is emitted in order as
CASE WHEN rule THEN false ... ELSE true END.

The fit takes the SAMPLE labelled rows whose id has the smallest hash; statistics are of all rows and whole texts.

Null and empty texts have statistics of 0. Ratios of texts without words are 0. Rows that repeat have equal statistics.
Labels with nulls don't count; of several for an id the smallest does. Without labels of both kinds the list has no rule and keeps
what the fixed rule keeps. An empty table gives an empty result. Columns beside doc_id and text (and quality) aren't read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import staged, words

SAMPLE, QUANTILES, MAX_RULES, MAX_CONDITIONS, PRECISION = 20_000, 24, 12, 4, 0.8
#: What a list may look at: ratios, so that a rule holds for texts of any length.
FEATURES = ("n_words", "chars_per_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "capital_share", "bang_share")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, and the features of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    only = lambda kinds: F.length(F.regexp_replace(F.col("text"), f"[^{kinds}]+", ""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # each projection is used more than once by the next, so that the optimiser keeps them apart
    d = d.select("doc_id", "text", words(F.col("text")).alias("w"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    windows = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.struct(F.xxhash64(F.get("w", i - 1), F.get("w", i), F.get("w", i + 1)).alias("h"), i.alias("i"))))
    d = d.select("doc_id", "text", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"), "lines", F.sort_array(windows).alias("s"))
    last = F.size("s") - 1
    near = lambda x, k: ((k > 0) & (F.get("s", k - 1).getField("h") == x.getField("h"))) | ((k < last) & (F.get("s", k + 1).getField("h") == x.getField("h")))
    d = d.select("*", F.filter("s", lambda x, k: F.coalesce(near(x, k), F.lit(False))).alias("twice"))
    covered = F.array_distinct(F.flatten(F.transform("twice", lambda x: F.array(x.getField("i"), x.getField("i") + 1, x.getField("i") + 2))))
    d = d.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        only("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.greatest(F.coalesce(F.size(covered), F.lit(0)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.col("n_distinct").cast("long").alias("n_distinct"),
        only("A-Z").cast("long").alias("n_capitals"),
        only("!").cast("long").alias("n_bangs"),
        F.size("lines").cast("long").alias("n_lines"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns(
        {
            "chars_per_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "distinct_share": share("n_distinct", "n_words"),
            "capital_share": share("n_capitals", "word_chars"),
            "bang_share": share("n_bangs", "n_words"),
        }
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.threshold) if self.above else F.col(self.feature) <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _bits(values: list[float], c: Condition) -> int:
    out = 0
    for k, x in enumerate(values):
        if (x > c.threshold) == c.above:
            out |= 1 << k
    return out


def grow_list(rows: list[tuple[dict[str, float], bool]]) -> list[Rule]:
    """Ordered rules for the rows marked True, from (features, mark) of each row."""
    grow_rows = [r for k, r in enumerate(rows) if k % 3]
    prune_rows = [r for k, r in enumerate(rows) if not k % 3]
    marks = [sum(1 << k for k, r in enumerate(part) if r[1]) for part in (grow_rows, prune_rows)]
    if not marks[0] or marks[0].bit_count() == len(grow_rows):
        return []
    conditions: list[tuple[Condition, int, int]] = []
    for f in FEATURES:
        values = [[r[0][f] for r in part] for part in (grow_rows, prune_rows)]
        ordered = sorted(values[0])
        cuts = sorted({ordered[min(len(ordered) - 1, len(ordered) * q // QUANTILES)] for q in range(QUANTILES)} | {ordered[min(len(ordered) - 1, len(ordered) * q // 200)] for q in (1, 2, 4, 196, 198, 199)})
        for t in cuts:
            for above in (True, False):
                c = Condition(f, above, float(t))
                conditions.append((c, _bits(values[0], c), _bits(values[1], c)))
    left = [(1 << len(part)) - 1 for part in (grow_rows, prune_rows)]
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and (left[0] & marks[0]):
        rule, cover = [], left[0]
        while len(rule) < MAX_CONDITIONS:
            p, n = (cover & marks[0]).bit_count(), (cover & ~marks[0]).bit_count()
            if not n:
                break
            before, best, gain = math.log2(p / (p + n)), None, 1e-9
            for x in conditions:
                now = cover & x[1]
                q = (now & marks[0]).bit_count()
                if q and (g := q * (math.log2(q / now.bit_count()) - before)) > gain:
                    best, gain = x, g
            if best is None:
                break
            rule.append(best)
            cover &= best[1]
        if not rule:
            break

        def worth(part):
            c = left[1]
            for x in part:
                c &= x[2]
            return ((c & marks[1]).bit_count() + 1) / (c.bit_count() + 2), c

        while len(rule) > 1 and worth(rule[:-1])[0] >= worth(rule)[0]:
            rule.pop()
        precision, pruned = worth(rule)
        if precision < PRECISION or pruned.bit_count() < 3:
            break
        rules.append(tuple(x[0] for x in rule))
        cover = left[0]
        for x in rule:
            cover &= x[1]
        left = [left[0] & ~cover, left[1] & ~pruned]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True where no rule holds, as one conditional expression."""
    out = F.lit(True)
    for rule in reversed(rules):
        holds = rule[0].column()
        for c in rule[1:]:
            holds = holds & c.column()
        out = F.when(holds, F.lit(False)).otherwise(out)
    return out


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = stats.join(lab, "doc_id").select("quality", *FEATURES, "doc_id").orderBy(F.xxhash64("doc_id"), *FEATURES).limit(sample).collect()
    return grow_list([({f: float(r[f]) for f in FEATURES}, r.quality == 0) for r in found])


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, list[Rule]]:
    """doc_id, counts, base_failed, kept of every row, and the learned list."""
    stats = staged(statistics(docs), "statistics")
    rules = fit(stats, labels, sample)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), rules
