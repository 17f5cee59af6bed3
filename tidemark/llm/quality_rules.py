"""Quality rules: a decision list learned by sequential covering, applied as one conditional expression."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import query, saved, table, unused, words

FEATURES = ("n_words", "chars_pct", "symbol_pct", "dup_line_pct", "repeat_pct", "upper_pct", "bang_pct")
MAX_TRAINING_ROWS = 20_000
MIN_PRECISION = 0.9
MIN_REJECTED = 5
MAX_RULES, MAX_LITERALS = 12, 4


class Literal(NamedTuple):
    feature: str
    at_least: bool
    threshold: float

    def column(self, row: Column | None = None) -> Column:
        value = F.col(self.feature) if row is None else row[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold


Rule = tuple[Literal, ...]


def with_counts(docs: DataFrame, column: str) -> DataFrame:
    """The rows with a struct ``column`` of the counts and features of ``text``, all within the row: no shuffle.

    Repeated words: windows of three words are hashed, sorted with their place,
    and those equal to a neighbour are repeated; the words they cover are
    counted from the distances of their places, at most three for each.
    """
    tokens, lines, grams, spots = unused(docs, "tokens", "lines", "grams", "spots")
    text = F.coalesce("text", F.lit(""))
    df = docs.withColumns(
        {
            tokens: words(F.col("text")),
            lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    n = F.size(tokens)
    hashed = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2))
    )
    df = df.withColumn(grams, F.when(n >= 3, hashed).otherwise(F.array().cast("array<bigint>")))
    placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn(
        spots,
        F.when(
            F.size(F.array_distinct(grams)) < F.size(grams), placed
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    df = df.withColumn(
        spots,
        F.sort_array(
            F.transform(
                F.filter(
                    spots,
                    lambda s, k: F.coalesce(s.h == F.get(spots, k - 1).h, F.lit(False))
                    | F.coalesce(s.h == F.get(spots, k + 1).h, F.lit(False)),
                ),
                lambda s: s.i,
            )
        ),
    )
    covered = F.aggregate(
        F.transform(spots, lambda s, k: F.least(s - F.coalesce(F.get(spots, k - 1), F.lit(-3)), F.lit(3))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    joined = F.array_join(tokens, "")

    def left_out(source: Column, kind: str) -> Column:
        return (F.length(source) - F.length(F.regexp_replace(source, f"[{kind}]+", ""))).cast("long")

    counts = F.struct(
        n.cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        left_out(joined, "#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        left_out(joined, "A-Z").alias("n_upper"),
        left_out(joined, "!").alias("n_bang"),
    )
    # Exploding an array of one keeps a later filter on the counts from being pushed below, where it would be
    # rewritten in terms of the arrays and sort them again for each element.
    df = df.withColumn(column, F.explode(F.array(counts))).drop(tokens, lines, grams, spots)
    c = F.col(column)

    def pct(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.lit(100.0) * c[part], c[whole].cast("double")), F.lit(0.0))

    return df.withColumn(
        column,
        F.struct(
            *(c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
            pct("word_chars", "n_words").alias("chars_pct"),
            pct("n_symbols", "n_words").alias("symbol_pct"),
            pct("n_dup_lines", "n_lines").alias("dup_line_pct"),
            pct("n_repeat_words", "n_words").alias("repeat_pct"),
            pct("n_upper", "word_chars").alias("upper_pct"),
            pct("n_bang", "n_words").alias("bang_pct"),
            ((c.n_words < 50) | (100 * c.n_repeat_words > 50 * c.n_words)).alias("base_failed"),
        ),
    )


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, bins: int = 32) -> list[Rule]:
    """Rules that reject, in order, learned from ``labels`` (doc_id, quality 0/1).

    At most ``max_rows`` labelled rows are used, those with the smallest hash of
    the id. Their features are counted in Spark by quantile bins, and the table
    of bins and labels, no longer than the sample, is what the search reads. A
    rule grows on two thirds by the literal of largest information gain and is
    pruned on the rest. It is taken while it holds a precision of
    ``MIN_PRECISION`` there. No labels, or labels of one class, give no rule.
    """
    sample = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    known = with_counts(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), "c").where("NOT c.base_failed")
    known = saved(known.select("doc_id", "quality", *(F.col(f"c.{k}").alias(k) for k in FEATURES)), "labelled")
    at = [i / bins for i in range(1, bins)]
    cuts = known.agg(*(F.percentile_approx(k, at, 10_000).alias(k) for k in FEATURES)).first()
    if any(cuts[k] is None for k in FEATURES):
        return []
    thresholds = {k: sorted(set(cuts[k])) for k in FEATURES}
    binned = [
        sum((F.col(k) >= t).cast("int") for t in thresholds[k]).alias(k) for k in FEATURES
    ]
    prune = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("prune")
    rows = known.groupBy(*binned, prune, (F.col("quality") == 0).alias("bad")).count().collect()
    return cover([(tuple(r[k] for k in FEATURES), r["prune"], r["bad"], r["count"]) for r in rows], thresholds)


def cover(rows: list[tuple], thresholds: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over (bins, prune, bad, count) rows."""
    rules: list[Rule] = []
    while len(rules) < MAX_RULES:
        found = pruned(grown([r for r in rows if not r[1]]), [r for r in rows if r[1]])
        if not found:
            break
        good, bad = tally(rows, found)
        held_good, held_bad = tally([r for r in rows if r[1]], found)
        if bad < MIN_REJECTED or min(share(bad, good), share(held_bad, held_good)) < MIN_PRECISION:
            break
        rules.append(tuple(Literal(FEATURES[f], up, thresholds[FEATURES[f]][cut]) for f, up, cut in found))
        rows = [r for r in rows if not holds(r[0], found)]
    return rules


def holds(bins: tuple, literals: list[tuple]) -> bool:
    return all((bins[f] > cut) == up for f, up, cut in literals)


def tally(rows: list[tuple], literals: list[tuple]) -> tuple[int, int]:
    good = bad = 0
    for bins, _, is_bad, n in rows:
        if holds(bins, literals):
            good, bad = (good, bad + n) if is_bad else (good + n, bad)
    return good, bad


def share(bad: int, good: int) -> float:
    return bad / (bad + good) if bad + good else 1.0


def grown(rows: list[tuple]) -> list[tuple]:
    """Adds the literal of largest gain until no good row is covered or none gains."""
    literals: list[tuple] = []
    while len(literals) < MAX_LITERALS:
        good = sum(n for _, _, bad, n in rows if not bad)
        bad = sum(n for _, _, bad, n in rows if bad)
        if not good or not bad:
            break
        best, choice = 0.0, None
        before = math.log2(share(bad, good))
        for f in range(len(FEATURES)):
            by_bin: dict[int, list[int]] = {}
            for bins, _, is_bad, n in rows:
                by_bin.setdefault(bins[f], [0, 0])[is_bad] += n
            below = [0, 0]
            for b in sorted(by_bin)[:-1]:
                below = [below[0] + by_bin[b][0], below[1] + by_bin[b][1]]
                for up, g, p in ((False, below[0], below[1]), (True, good - below[0], bad - below[1])):
                    gain = p * (math.log2(share(p, g)) - before) if p else 0.0
                    if gain > best + 1e-9:
                        best, choice = gain, (f, up, b)
        if choice is None:
            break
        literals.append(choice)
        rows = [r for r in rows if holds(r[0], [choice])]
    return literals


def pruned(literals: list[tuple], rows: list[tuple]) -> list[tuple]:
    """Cuts last literals while that raises (bad - good) / (bad + good) on rows not grown on."""

    def worth(kept: list[tuple]) -> float:
        good, bad = tally(rows, kept)
        return (bad - good) / (bad + good) if bad + good else -1.0

    while len(literals) > 1 and worth(literals[:-1]) > worth(literals):
        literals = literals[:-1]
    return literals


def verdict(rules: list[Rule], row: Column) -> Column:
    """The list as one expression: the first rule that holds rejects, and what no rule holds for stays."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = rule[0].column(row)
        for literal in rule[1:]:
            test = test & literal.column(row)
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], column: str) -> DataFrame:
    """The rows with a struct ``column``: counts, ``base_failed`` and ``kept``.

    A null or empty text has no words and fails the base rule. Rows are judged
    each for itself, so repeated rows and ties of the id get the same verdict.
    """
    df = with_counts(docs, column)
    c = F.col(column)
    return df.withColumn(column, c.withField("kept", ~c.base_failed & verdict(rules, c)))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each document."""
    docs = table(spark, sf_dir, "documents")
    rules = learn(docs, table(spark, sf_dir, "labels"))
    return judged(docs.select("doc_id", "text"), rules, "c").select(
        "doc_id",
        *(
            F.col(f"c.{k}").alias(k)
            for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        ),
    )
