"""Quality rules: a learned decision list over text statistics, in DataFrame expressions from end to end.

Sequential covering: a rule is a conjunction of thresholds, grown one condition at a time by the gain in labelled junk rows that it still covers, then pruned
on rows that growing didn't see; rows that a rule covers leave the table, and the next rule grows from the rest. Each step counts rows by statistic and bin in Spark;
some hundred counts reach the driver. The list comes out as one ``CASE`` expression.

Rules are learned from a sample of at most SAMPLE labelled rows, chosen by hash; the statistics and the verdict cover every row.

Defined cases: a null or blank text has no words and fails the base rules; a text of any length is measured whole; repeated rows are measured and judged each, alike; an empty table gives an empty result; a row without doc_id or label teaches nothing; a repeated doc_id in labels counts once, with its greatest label;
without labels of both kinds the list is empty and only the base rules count; ties between conditions go to the first statistic and the lowest threshold; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, labelled_sample, let, scratch, table, word_array, written

#: Labelled rows to learn from at most; words in a window; cut points of a statistic; what a rule must cover, and how surely.
SAMPLE, WINDOW, CUTS, MOST_RULES, MOST_CONDITIONS, LEAST_ROWS, LEAST_PRECISION = 20_000, 8, 24, 8, 3, 5, 0.9
SYMBOLS = "#*$%&|<>"


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the array, overlaps counted once."""

    def covered(places: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(places) - 1), lambda j: F.least(F.lit(WINDOW), F.get(places, j) - F.get(places, j - 1)))
        return F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x)

    def repeated(ordered: Column) -> Column:
        same = lambda i, j: F.coalesce(F.get(ordered, i)["h"] == F.get(ordered, j)["h"], F.lit(False))
        hit = F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: F.when(same(i, i - 1) | same(i, i + 1), F.get(ordered, i)["at"]))
        return let(F.sort_array(F.filter(hit, lambda x: x.isNotNull())), covered)

    def windows(hashes: Column) -> Column:
        return let(
            F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(F.slice(hashes, i + 1, WINDOW))),
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(let(F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("at")))), repeated)),
        )

    return F.when(F.size(words) < WINDOW, 0).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def measured(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and shares for the rules (double): upper, marks, digits."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = let(F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    both = let(word_array(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    upper = F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    out = df.select(
        *keep, both.alias("_both"), F.length(F.translate(t, SPACES, "")).alias("_chars"), _count(t, SYMBOLS).alias("_symbols"), lines.alias("_lines"),
        upper.alias("_upper"), _count(t, "!?").alias("_marks"), _count(t, "0123456789").alias("_digits"),
    )
    least = F.greatest(F.col("_chars"), F.lit(1))
    return out.select(
        *keep, F.col("_both.n").cast("long").alias("n_words"), F.col("_chars").cast("long").alias("word_chars"), F.col("_symbols").cast("long").alias("n_symbols"), F.col("_lines").cast("long").alias("n_dup_lines"), F.col("_both.r").cast("long").alias("n_repeat_words"),
        (F.col("_upper") / least).alias("upper"), (F.col("_marks") / least).alias("marks"), (F.col("_digits") / least).alias("digits"),
    )


def statistics() -> dict[str, Column]:
    """What rules test, by name, over measured()."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {"symbol_share": F.col("n_symbols") / chars, "word_length": F.col("word_chars") / words, "dup_lines_by_words": F.col("n_dup_lines") / words, "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("upper"), "mark_share": F.col("marks"), "digit_share": F.col("digits"), "n_words": F.col("n_words").cast("double")}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges are at most value."""
    return F.size(F.filter(F.array(*(F.lit(float(e)) for e in edges)), lambda e: e <= value))


@dataclass(frozen=True)
class Condition:
    name: str
    at_least: bool
    cut: float
    number: int  # of the cut: bins with this number and over are at_least
    place: int  # of the statistic

    def test(self) -> Column:
        value = statistics()[self.name]
        return value >= self.cut if self.at_least else value < self.cut

    def test_bin(self) -> Column:
        b = F.get("bins", F.lit(self.place))
        return b >= self.number if self.at_least else b < self.number


def _all(tests: list[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def _gain(junk: int, good: int, junk0: int, good0: int) -> float:
    """Bits that narrowing (junk0, good0) to (junk, good) saves, over the junk rows kept."""
    return junk * (math.log2(junk / (junk + good)) - math.log2(junk0 / (junk0 + good0))) if junk else -math.inf


def learn(rows: DataFrame) -> list[list[Condition]]:
    """The decision list from measured() rows with ``_label`` (0: junk): conjunctions, in order; what one covers is junk."""
    stats = statistics()
    names = list(stats)
    cuts = rows.agg(*(F.percentile_approx(c, [(i + 0.5) / CUTS for i in range(CUTS)], 10_000).alias(f"a{i}") for i, c in enumerate(stats.values())), *(F.percentile_approx(F.when(F.col("_label") == 0, c), [i / CUTS for i in range(CUTS + 1)], 10_000).alias(f"j{i}") for i, c in enumerate(stats.values()))).first()
    edges = [sorted({*(cuts[f"a{i}"] or []), *(cuts[f"j{i}"] or [])}) for i in range(len(names))]
    if not all(edges):
        return []
    bins = F.array(*(_bin(c, edges[i]) for i, c in enumerate(stats.values())))
    left = written(rows.select(bins.alias("bins"), "_label", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune")), "binned")
    found: list[list[Condition]] = []
    covered = F.lit(False)
    while len(found) < MOST_RULES:
        rule: list[Condition] = []
        open_rows = left.where(~covered)
        while len(rule) < MOST_CONDITIONS:
            counts = open_rows.where(~F.col("prune")).where(_all([c.test_bin() for c in rule])).select("_label", F.posexplode("bins")).groupBy("pos", "col").agg(F.count_if(F.col("_label") == 0).alias("junk"), F.count_if(F.col("_label") != 0).alias("good")).collect()
            junk0 = sum(r["junk"] for r in counts if r["pos"] == 0)
            good0 = sum(r["good"] for r in counts if r["pos"] == 0)
            if not junk0 or not good0:
                break
            best = None
            for place, name in enumerate(names):
                by_bin = {r["col"]: (r["junk"], r["good"]) for r in counts if r["pos"] == place}
                for k in range(1, len(edges[place]) + 1):
                    over = [sum(v[n] for b, v in by_bin.items() if b >= k) for n in (0, 1)]
                    for at_least, (junk, good) in ((True, over), (False, (junk0 - over[0], good0 - over[1]))):
                        if junk >= LEAST_ROWS and (best is None or _gain(junk, good, junk0, good0) > best[0]):
                            best = (_gain(junk, good, junk0, good0), Condition(name, at_least, float(edges[place][k - 1]), k, place))
            if best is None or best[0] <= 0:
                break
            rule.append(best[1])
        rule = _pruned(open_rows.where("prune"), rule)
        if not rule:
            break
        found.append(rule)
        covered = covered | _all([c.test_bin() for c in rule])
    return found


def _pruned(rows: DataFrame, rule: list[Condition]) -> list[Condition]:
    """The beginning of rule that tells most on unseen rows; none if no beginning is sure enough."""
    if not rule:
        return []
    counts = [(F.count_if(_all([c.test_bin() for c in rule[:n]]) & (F.col("_label") == label))).alias(f"c{n}_{label}") for n in range(1, len(rule) + 1) for label in (0, 1)]
    row = rows.agg(*counts).first()
    worth = [(row[f"c{n}_0"] - row[f"c{n}_1"], -n) for n in range(1, len(rule) + 1) if row[f"c{n}_0"] and row[f"c{n}_0"] >= LEAST_PRECISION * (row[f"c{n}_0"] + row[f"c{n}_1"])]
    return rule[: -max(worth)[1]] if worth else []


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one expression over measured(): false for junk."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(_all([c.test() for c in rule]), False)
    return out.otherwise(True)


def fit(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> list[list[Condition]]:
    """Learn from labelled rows. The sample has a bound, so it may be sent to every task."""
    chosen = labelled_sample(labels, "quality", bound)
    rows = written(measured(documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), keep=("doc_id", "_label")), "measured")
    return learn(rows.where(~base_failed()))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    with scratch(spark):
        rules = fit(documents, table(spark, sf_dir, "labels"))
    rows = measured(documents).select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
