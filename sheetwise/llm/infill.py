"""Fill-in-middle: texts cut into prefix, middle and suffix at unit boundaries, and put back together.

A unit grammar says which neighbouring character classes stay in one unit. It is translated to a regex of no width that matches between two characters whose
classes part, so that Spark's split cuts there and loses nothing. All of it is DataFrame expressions: no row leaves its task.

Defined cases: a null text is the empty text; the empty text has no units (split would give one) and stays plain; a text that holds a sentinel stays plain; a null key counts as the empty
string; repeated rows are cut alike; texts of any length are cut whole; an empty table gives an empty result; columns beside the key pass through, and one named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE, OTHER = "\\x20\\x09-\\x0D", "^\\x20\\x09-\\x0D"


@dataclass(frozen=True)
class Grammar:
    """classes: a name and what stands between brackets in a regex, a partition of the characters. together: pairs of classes (left, right) that no boundary parts."""

    classes: dict[str, str]
    together: frozenset[tuple[str, str]]

    def boundary(self) -> str:
        """The regex of the places between two units, one alternative for each left class that ends units."""
        places = []
        for left, chars in self.classes.items():
            right = [b for b in self.classes if (left, b) not in self.together]
            if right:
                places.append(f"(?<=[{chars}])(?:{'|'.join(f'(?=[{self.classes[b]}])' for b in right)})")
        return "|".join(places) or "(?!)"


GRAMMARS = {
    # A word with the white space before it; white space at the end is a unit of its own.
    "token": Grammar({"space": SPACE, "other": OTHER}, frozenset({("space", "space"), ("space", "other"), ("other", "other")})),
    # Words and white space apart.
    "run": Grammar({"space": SPACE, "other": OTHER}, frozenset({("space", "space"), ("other", "other")})),
    # A line with its end.
    "line": Grammar({"end": "\\n", "other": "^\\n"}, frozenset({("other", "end"), ("other", "other")})),
    # Each code point; nothing stays together.
    "character": Grammar({"any": "\\x{0}-\\x{10FFFF}"}, frozenset()),
}


def units(text: Column, grammar: Grammar) -> Column:
    """The units of a text in order; none for the empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, grammar.boundary(), -1))


@dataclass(frozen=True)
class Infill:
    """seed goes into the hash of each key; rate: percent of the texts that are cut; spm: percent of those whose suffix comes first; sentinels before prefix, suffix and middle."""

    seed: int = 42
    rate: int = 50
    spm: int = 80
    grammar: str = "token"
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        p, s, m = self.sentinels
        if not all(len(x) == 3 and x[0] == "<" and x[2] == ">" and x[1] not in "<>" for x in self.sentinels) or len({p, s, m}) < 3:
            raise ValueError("sentinels must be three different signs like <P>: then none can arise where a sentinel meets a text")

    def transform(self, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """df with n, form, prefix_chars, middle_chars and output."""
        p, s, m = self.sentinels
        made = ("n", "form", "prefix_chars", "middle_chars", "output")
        kept = [c for c in df.columns if c not in made]
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
        h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
        whole = F.coalesce(F.col(text), F.lit(""))
        plain = (whole == "") | F.contains(whole, F.lit(p)) | F.contains(whole, F.lit(s)) | F.contains(whole, F.lit(m)) | (h[2] % 100 >= self.rate)
        form = F.when(plain, "plain").when(h[3] % 100 < self.spm, "spm").otherwise("psm")
        own = "_infill"
        while any(c.startswith(own) for c in kept):
            own += "_"
        name = lambda c: f"{own}_{c}"
        cut = df.select(*(F.col(f"`{c}`") for c in kept), whole.alias(name("text")), units(whole, GRAMMARS[self.grammar]).alias(name("units")), form.alias("form"), *(h[k].alias(name(f"h{k}")) for k in range(2)))
        size = F.size(name("units"))
        a, b = (F.col(name(f"h{k}")) % (size + 1) for k in range(2))
        cut = cut.withColumns({"n": size.cast("long"), name("from"): F.least(a, b).cast("int"), name("to"): F.greatest(a, b).cast("int")})
        part = lambda begin, end: F.array_join(F.slice(name("units"), begin + 1, end - begin), "")
        begin, end = F.col(name("from")), F.col(name("to"))
        cut = cut.withColumns({name("p"): F.when(F.col("form") != "plain", part(F.lit(0), begin)), name("m"): F.when(F.col("form") != "plain", part(begin, end)), name("s"): F.when(F.col("form") != "plain", part(end, F.col("n").cast("int")))})
        prefix, middle, suffix = (F.col(name(c)) for c in "pms")
        output = F.when(F.col("form") == "plain", F.col(name("text"))).when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle))
        chars = lambda c: F.char_length(c).cast("long")
        return cut.select(*(F.col(f"`{c}`") for c in kept), "n", "form", chars(prefix).alias("prefix_chars"), chars(middle).alias("middle_chars"), output.alias("output"))

    def restore(self, output: Column, form: Column) -> Column:
        """The text of an output: the sentinels tell the three parts apart, as the text holds none."""
        p, s, m = self.sentinels
        parts = F.split(output, f"\\Q{p}\\E|\\Q{s}\\E|\\Q{m}\\E", -1)  # the first is empty
        one, two, middle = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
        return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    infill = Infill()
    out = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
            regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u FROM documents),
    h AS (SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(d, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(d, 25, 8) AS BIGINT) AS h4 FROM d),
    f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
    p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM f)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
    FROM p"""
