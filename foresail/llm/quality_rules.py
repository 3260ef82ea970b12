"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Every measure is a Column; a rule bounds a ratio of two integer measures, and is
compared without division, so each engine gives the same verdict. No user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, SPACES, ascii_lower, table

# Common function words of four languages.
STOP_WORDS = (
    "the be to of and that have with for in is it on as was are by this from at or not "
    "der die und das von zu mit den ist im ein eine auf für sich nicht als auch "
    "le la les de des et que en un une dans pour est qui sur pas au du "
    "el los las y del por con no se lo para una su al"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails when low * over > measure or measure > high * over, in hundredths."""

    name: str
    measure: str
    over: str
    low: int | None = None
    high: int | None = None

    def fails(self) -> Column:
        m, o = F.col(self.measure) * 100, F.col(self.over)
        out = F.lit(False)
        if self.low is not None:
            out = out | (m < o * self.low)
        if self.high is not None:
            out = out | (m > o * self.high)
        return out

    def sql(self) -> str:
        parts = [f"100 * {self.measure} < {self.low} * {self.over}"] if self.low is not None else []
        parts += [f"100 * {self.measure} > {self.high} * {self.over}"] if self.high is not None else []
        return f"({' OR '.join(parts)})"


#: The threshold table. Bounds are in hundredths of ``over``.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=200, high=1300),
    Rule("symbols_per_word", "n_symbols", "n_words", high=10),
    Rule("stop_words", "n_stop_words", "n_words", low=1),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows found twice or more.

    Windows are sorted with their place, so equal ones are neighbours: n log n for any length.
    Texts without a repeated window are settled by one hash set.
    """
    def of(w: Column) -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return F.element_at(F.transform(F.array(grams), covered), 1)

    def covered(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            F.element_at(F.transform(F.array(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))), places), 1)
        )

    def places(s: Column) -> Column:
        found = F.filter(
            F.transform(s, lambda x, j: F.when((x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"]), x["i"])),
            lambda i: i.isNotNull(),
        )
        return F.element_at(F.transform(F.array(F.array_sort(found)), total), 1)

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    one = F.element_at(F.transform(F.array(words), of), 1)
    return F.when(F.size(words) >= 4, one).otherwise(F.lit(0)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of ``text`` in a struct column ``m``; null text has no word and no line."""
    t = F.coalesce(docs[text], F.lit(""))
    staged = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("r"),
        t.alias("t"),
        F.filter(F.split(t, SPACE_CLASS), lambda w: w != "").alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "").alias("l"),
        F.filter(F.split(ascii_lower(t), SPACE_CLASS), lambda w: w.isin(STOP_WORDS)).alias("s"),
    )
    t, w, l = F.col("t"), F.col("w"), F.col("l")  # noqa: E741
    return staged.select(
        "r",
        F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(l) - F.size(F.array_distinct(l))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size("s").cast("long").alias("n_stop_words"),
            F.size(l).cast("long").alias("n_lines"),
            F.size(F.filter(l, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long").alias("n_ellipsis_lines"),
            F.size(F.filter(l, lambda x: F.ltrim(x).startswith("•") | F.ltrim(x).startswith("- "))).cast("long").alias("n_bullet_lines"),
        ).alias("m"),
    )


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Columns r (the row as it came), m (the measures), base_failed, failed_rules and kept.

    A document fails at base with under 50 words or with more than half of its words in
    repeated 3-word windows. Null and empty texts fail at base. Row order and repeated rows
    do not matter: each row is judged by itself.
    """
    base = (F.col("m.n_words") < 50) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 50)
    flat = measures(docs, text).select("r", "m", base.alias("base_failed"), "m.*")
    failed = F.filter(F.array(*[F.when(x.fails(), F.lit(x.name)) for x in rules]), lambda x: x.isNotNull())
    return flat.select("r", "m", "base_failed", failed.alias("failed_rules")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of all ``documents``. Null, empty and wordless texts have no words and fail, repeated rows each have a row, an empty table gives none."""
    out = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "r.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept",
        "m.n_stop_words", "m.n_lines", F.concat_ws(",", "failed_rules").alias("failed_rules"),
    )


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes, whole; null, empty and wordless texts go, repeated rows and null doc_ids are judged like others. An empty table stays empty."""
    # A filter would be pushed below the measures and have them taken twice; an exploded list of one row or none is not.
    rows = judged(docs).select(F.explode(F.when(F.col("kept"), F.array("r")).otherwise(F.array().cast(_list_of(docs)))).alias("r"))
    return rows.select("r.*")


def _list_of(docs: DataFrame) -> T.ArrayType:
    return T.ArrayType(docs.schema)


_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
MEASURES_SQL = f"""
  base AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
  ),
  parts AS (
    SELECT rid, doc_id, t,
      list_filter(regexp_split_to_array(t, '{SPACE_CLASS}'), lambda w: w <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{SPACE_CLASS}', '', 'g') <> '') AS l,
      list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE_CLASS}'),
                  lambda w: w IN ({_LIST})) AS s
    FROM base
  ),
  grams AS (
    SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)
  ),
  rep AS (
    SELECT rid, count(DISTINCT p) AS n FROM (
      SELECT rid, unnest([i, i + 1, i + 2]) AS p
      FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c >= 2
    ) GROUP BY rid
  ),
  m AS (
    SELECT rid, doc_id,
      CAST(len(w) AS BIGINT) AS n_words,
      CAST(length(regexp_replace(t, '{SPACE_CLASS}', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
      CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(len(s) AS BIGINT) AS n_stop_words,
      CAST(len(l) AS BIGINT) AS n_lines,
      CAST(len(list_filter(l, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS BIGINT) AS n_ellipsis_lines,
      CAST(len(list_filter(l, lambda x: ltrim(x, ' ') LIKE '•%' OR ltrim(x, ' ') LIKE '- %')) AS BIGINT) AS n_bullet_lines
    FROM parts LEFT JOIN rep USING (rid)
  ),
  judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
      concat_ws(',', {", ".join(f"CASE WHEN {r.sql()} THEN '{r.name}' END" for r in RULES)}) AS failed_rules
    FROM m
  )
"""
ORACLE = f"""
WITH {MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, n_stop_words, n_lines, failed_rules
FROM judged
"""
