"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text are hashed (128 bits). A window that occurs more than once anywhere stays where it comes first, in the order
of (key, line); the lines that its later occurrences cover are removed, overlapping occurrences merged. A window of blank lines only doesn't count.

Windows are counted before they are shuffled, only windows that repeat are joined back, and the join's large side can be split, so a passage
that a third of the texts share is no hot spot.

Defined cases: a null text stays null, a text of one or two lines stays as it is, a text of any length is windowed whole; rows without key come first in the order; rows with equal key and text are
one document (the same one, read twice) and are treated alike, so its lines aren't repeats of themselves; rows with equal key and other texts follow one another by a hash of the text; all other columns pass unchanged, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, table

FIRST = -(1 << 63)


def _windows(lines: Column, size: int) -> Column:
    def of(i: Column) -> Column:
        part = [F.get(lines_, i + k) for k in range(size)]
        return F.struct(i.alias("at"), F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *reversed(part)).alias("h2"), (F.btrim(F.concat(*part), F.lit(SPACES)) != "").alias("full"))

    def all_of(bound: Column) -> Column:
        nonlocal lines_
        lines_ = bound
        return F.when(F.size(bound) >= size, F.filter(F.transform(F.sequence(F.lit(0), F.size(bound) - size), of), lambda w: w["full"]))

    lines_ = lines
    return let(lines, all_of)


def covered_lines(df: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(_sw_key, _sw_text hash, _sw_drop: numbers of the lines to remove) for each document that loses lines."""
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("_sw_key"), F.xxhash64(text).alias("_sw_hash"), _windows(F.split(F.col(text), "\n", -1), size).alias("_sw_w"))
    windows = rows.select("_sw_key", "_sw_hash", F.explode("_sw_w").alias("w")).select(F.struct("_sw_key", "_sw_hash", "w.at").alias("place"), "w.h1", "w.h2")
    repeated = windows.groupBy("h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where("place <> first").select("place.*")
    spread = F.array_distinct(F.flatten(F.transform(F.collect_set("at"), lambda i: F.sequence(i, i + size - 1))))
    return later.groupBy("_sw_key", "_sw_hash").agg(spread.alias("_sw_drop"))


def without_repeats(df: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated windows removed from text, and with ``_sw_lines`` and ``_sw_gone``: the numbers of lines before and removed."""
    drop = covered_lines(df, size, key, text)
    joined = df.withColumn("_sw_key", F.coalesce(F.col(key).cast("long"), F.lit(FIRST))).withColumn("_sw_hash", F.xxhash64(text)).join(drop, ["_sw_key", "_sw_hash"], "left")
    rest = let(F.split(F.col(text), "\n", -1), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_sw_drop")), lambda i: F.get(lines, i)), "\n"))
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.split(F.col(text), "\n", -1)))
    out = joined.withColumn("_sw_lines", count).withColumn("_sw_gone", F.coalesce(F.size("_sw_drop"), F.lit(0))).withColumn(text, F.when(F.col("_sw_drop").isNull(), F.col(text)).otherwise(rest))
    return out.select(*df.columns, "_sw_lines", "_sw_gone")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_sw_lines").alias("n_lines"), F.col("_sw_gone").alias("n_removed"), "text")


ORACLE = """
    WITH texts AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS t, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
    lines AS (
        SELECT t, doc_id, i, string_split(text, chr(10)) AS l FROM texts, LATERAL (SELECT unnest(range(len(string_split(text, chr(10))))) AS i)),
    windows AS (
        SELECT t, doc_id, i, l[i + 1] AS a, l[i + 2] AS b, l[i + 3] AS c FROM lines
        WHERE i + 2 < len(l) AND trim(l[i + 1] || l[i + 2] || l[i + 3], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
    ranked AS (SELECT t, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id NULLS FIRST, t, i) AS r FROM windows),
    gone AS (SELECT DISTINCT t, i + k AS i FROM ranked, (SELECT unnest(range(3)) AS k) WHERE r > 1),
    done AS (
        SELECT lines.t, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(gone.i) AS INTEGER) AS n_removed,
            coalesce(string_agg(l[lines.i + 1], chr(10) ORDER BY lines.i) FILTER (WHERE gone.i IS NULL), '') AS text
        FROM lines LEFT JOIN gone ON lines.t = gone.t AND lines.i = gone.i GROUP BY lines.t)
    SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN done.text END AS text
    FROM documents d JOIN texts ON d.doc_id IS NOT DISTINCT FROM texts.doc_id AND d.text IS NOT DISTINCT FROM texts.text LEFT JOIN done USING (t)"""
