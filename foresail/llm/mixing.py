"""Mixing sources to target weights by hierarchical budgeting.

Leaves are domain / language / source. The budget flows down the tree in proportion to
the weights; a node that has less than its share gives the shortage to its siblings, and
only what they cannot take goes to the level above, since every node is capped by what
its whole subtree holds. Each leaf then takes whole seeded epochs and a prefix of one more.
All is DataFrame code; budgets are integers, so every engine gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_CLASS, discard, table, written

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixPlan:
    """Weights by level and node name (default 1), all positive integers.

    budget_percent: tokens to select, in percent of all tokens. max_epochs: how often a
    document may be taken. seed: of the epochs' orders.
    """

    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    budget_percent: int = 80
    max_epochs: int = 3
    seed: int = 17

    def weight(self, level: str) -> Column:
        out = F.lit(1)
        for name, w in self.weights.get(level, {}).items():
            out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
        return out.cast("decimal(38,0)")


PLAN = MixPlan(weights={"domain": {"web": 1, "curated": 2}, "lang": {"en": 3, "de": 2}})
#: For the pipeline, where a document that near-duplicate removal kept must not come twice.
PIPELINE_PLAN = MixPlan(weights=PLAN.weights, budget_percent=80, max_epochs=1)


def domain_of(source: Column) -> Column:
    """Sources whose number is under 10 are web, the others curated; without a number, other."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    return F.when(number == "", "other").when(number.cast("int") < 10, "web").otherwise("curated")


def leaf_of(docs: DataFrame) -> list[Column]:
    """domain, lang, source of each row; null language or source is the empty name."""
    names = [F.coalesce(docs[c], F.lit("")) for c in ("lang", "source")]
    return [c.alias(level) for c, level in zip([domain_of(docs["source"]), *names], LEVELS)]


def order_of(plan: MixPlan, epoch: Column) -> Column:
    """By what an epoch is ordered: md5 of seed, epoch and doc_id."""
    return F.md5(F.concat_ws("|", F.lit(str(plan.seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def token_table(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, tokens. Tokens are words; rows of one doc_id and leaf count together.

    Null language or source is the empty name, null text has no token, and rows with a null doc_id are left out:
    nothing could select them.
    """
    rows = docs.where(docs["doc_id"].isNotNull()).select(
        "doc_id",
        *leaf_of(docs),
        F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD_CLASS)).cast("long").alias("tokens"),
    )
    return rows.groupBy("doc_id", *LEVELS).agg(F.sum("tokens").alias("tokens"))


def _fill(children: DataFrame, parents: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Budgets of children (keys, name, cap, w) from those of their parents (keys, budget).

    Siblings are ordered by cap / w. A prefix of them is filled to its cap; the rest
    share what is left by weight, rounded down.
    """
    rows = children.join(parents, keys) if keys else children.crossJoin(parents)
    rows = rows.withColumn("ratio", F.col("cap").cast("double") / F.col("w").cast("double"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = part.orderBy("ratio", name).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("cum", F.sum("cap").over(upto)).withColumn("rem", F.sum("w").over(part) - F.sum("w").over(upto))
    full = (F.col("cum") * F.col("w") + F.col("cap") * F.col("rem")) <= F.col("budget") * F.col("w")
    rows = rows.withColumn("full", full)
    rows = rows.withColumn("spent", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(part))
    rows = rows.withColumn("left_w", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(part))
    share = F.expr("CASE WHEN full THEN cap ELSE CAST(CAST((budget - spent) * w AS DECIMAL(38,0)) div left_w AS DECIMAL(38,0)) END")
    return rows.select(*keys, name, share.cast("decimal(38,0)").alias("budget"))


def leaf_budgets(tokens: DataFrame, plan: MixPlan) -> DataFrame:
    """domain, lang, source, total, budget: one row a leaf. The tree is small beside the rows; it stays distributed all the same."""
    leaves = tokens.groupBy(*LEVELS).agg(F.sum("tokens").alias("total"))
    leaves = leaves.withColumn("cap", (F.col("total") * plan.max_epochs).cast("decimal(38,0)"))
    nodes = [leaves]
    for k in (2, 1):
        nodes.append(nodes[-1].groupBy(*LEVELS[:k]).agg(F.sum("cap").cast("decimal(38,0)").alias("cap")))
    nodes.reverse()
    wanted = F.least(
        F.expr(f"CAST(CAST(sum(total) AS DECIMAL(38,0)) * {plan.budget_percent} div 100 AS DECIMAL(38,0))"), F.sum("cap")
    ).cast("decimal(38,0)")
    parents = leaves.agg(F.coalesce(wanted, F.lit(0)).cast("decimal(38,0)").alias("budget"))
    for k, level in enumerate(LEVELS):
        children = nodes[k].withColumn("w", plan.weight(level)).select(*LEVELS[: k + 1], "cap", "w")
        parents = _fill(children, parents, list(LEVELS[:k]), level)
    return leaves.select(*LEVELS, "total").join(parents, list(LEVELS)).select(*LEVELS, "total", F.col("budget").cast("long").alias("budget"))


def select(docs: DataFrame, plan: MixPlan) -> DataFrame:
    """Rows doc_id, domain, lang, source, tokens, epoch (from 0), leaf_budget of the mixture.

    A leaf's last epoch is ordered by md5 of seed, epoch and doc_id (ties by doc_id); a document is taken while
    the tokens before it are under the budget. That order is cut by leading digits of the md5: buckets wholly
    inside or outside the prefix are settled by their sums, and only the bucket on the edge is ordered row by
    row, so that a leaf with a third of all rows needs no task of its own. Leaves without tokens give nothing.
    """
    tokens = written(token_table(docs), "mix-tokens")
    leaves = written(leaf_budgets(tokens, plan).where("total > 0"), "mix-leaves")
    rows = tokens.join(leaves, list(LEVELS))
    rows = rows.select(
        "doc_id", *LEVELS, "tokens", F.col("budget").alias("leaf_budget"),
        F.expr("budget div total").alias("whole"), F.expr("budget % total").alias("rest"),
    )
    rows = rows.withColumn("h", order_of(plan, F.col("whole")))
    rows = written(rows, "mix-rows")
    out = ["doc_id", *LEVELS, "tokens", "epoch", "leaf_budget"]
    parts = [rows.where("whole > 0").withColumn("epoch", F.explode(F.expr("sequence(0L, whole - 1)"))).select(*out)]
    open_ = rows.where("rest > 0").withColumn("base", F.lit(0).cast("long"))
    used = [tokens, leaves]
    for level in range(2):
        open_ = open_.withColumn("b", F.substring("h", 1 + 2 * level, 2))
        sums = open_.groupBy(*LEVELS, "b").agg(F.sum("tokens").alias("s"))
        before = Window.partitionBy(*LEVELS).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        sums = written(sums.withColumn("before", F.coalesce(F.sum("s").over(before), F.lit(0).cast("long"))), "mix-buckets")
        rows_b = open_.join(sums, [*LEVELS, "b"]).withColumn("lo", F.col("base") + F.col("before"))
        parts.append(rows_b.where("lo < rest AND lo + s <= rest").withColumn("epoch", F.col("whole")).select(*out))
        edge = rows_b.where("lo < rest AND lo + s > rest").select(*[c for c in rows.columns], F.col("lo").alias("base"))
        open_ = written(edge, "mix-edge")
    run = Window.partitionBy(*LEVELS).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    last = open_.withColumn("lo", F.col("base") + F.coalesce(F.sum("tokens").over(run), F.lit(0).cast("long")))
    parts.append(last.where("lo < rest").withColumn("epoch", F.col("whole")).select(*out))
    discard(*used)
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all ``documents``. Rows without a doc_id cannot be named and take no part, nor do texts without a word, null or empty; rows that repeat a doc_id in a leaf are one document with their words added up; null lang or source is the empty name; an empty table gives no row."""
    return select(table(spark, sf_dir, "documents"), PLAN)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, each once, with all their columns; rows without a doc_id or a word go, as they cannot be drawn. An empty table stays empty.

    Texts are read where they lie, neither shuffled nor sorted: what a leaf gives to its first epoch is a prefix of that
    epoch's order, so a row is held against the last one drawn from its leaf. Only ids that stand in several leaves are listed, as
    their rows stay together if any is drawn.
    """
    drawn = written(select(docs, PIPELINE_PLAN).where("epoch = 0").select("doc_id", *LEVELS), "mix-drawn")
    order = F.struct(order_of(PIPELINE_PLAN, F.lit(0)).alias("h"), F.col("doc_id"))
    last = written(drawn.groupBy(*LEVELS).agg(F.max(order).alias("mix_last")), "mix-last")
    places = docs.where("doc_id IS NOT NULL").select("doc_id", F.struct(*leaf_of(docs)).alias("leaf"))
    several = places.groupBy("doc_id").agg(F.min("leaf").alias("l0"), F.max("leaf").alias("l1")).where("l0 <> l1").select("doc_id")
    several = written(several.join(drawn, "doc_id", "left_semi").withColumn("mix_any", F.lit(True)), "mix-several")
    discard(drawn)
    keys = [c.alias(f"mix_{level}") for c, level in zip(leaf_of(docs), LEVELS)]
    last = last.select(*[F.col(level).alias(f"mix_{level}") for level in LEVELS], "mix_last")
    rows = docs.where("doc_id IS NOT NULL").select(*docs.columns, *keys).join(last, [f"mix_{level}" for level in LEVELS], "left")
    rows = rows.join(several, "doc_id", "left").where((order <= F.col("mix_last")) | F.col("mix_any"))
    return rows.select(*docs.columns)


def _weight_sql(plan: MixPlan, level: str) -> str:
    cases = " ".join(f"WHEN {level} = '{n}' THEN {w}" for n, w in plan.weights.get(level, {}).items())
    return f"CAST(CASE {cases} ELSE 1 END AS HUGEINT)" if cases else "CAST(1 AS HUGEINT)"


def mix_sql(docs: str, plan: MixPlan) -> str:
    """CTEs mix_* in DuckDB's SQL over a relation with doc_id, text, lang, source; the last, mix_out, has the rows of ``select``."""
    out = f"""
  mix_tok AS (
    SELECT doc_id, domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM (
      SELECT doc_id,
        CASE WHEN n = '' THEN 'other' WHEN CAST(n AS INTEGER) < 10 THEN 'web' ELSE 'curated' END AS domain, lang, source,
        len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS tokens
      FROM (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN '' ELSE regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) END AS n
            FROM {docs} WHERE doc_id IS NOT NULL)
      ) GROUP BY ALL
  ),
  mix_n3 AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS total, CAST(sum(tokens) AS HUGEINT) * {plan.max_epochs} AS cap FROM mix_tok GROUP BY ALL),
  mix_n2 AS (SELECT domain, lang, sum(cap) AS cap FROM mix_n3 GROUP BY ALL),
  mix_n1 AS (SELECT domain, sum(cap) AS cap FROM mix_n2 GROUP BY ALL),
  mix_b0 AS (SELECT CAST(least(CAST(sum(total) AS HUGEINT) * {plan.budget_percent} // 100, CAST(sum(cap) AS HUGEINT)) AS HUGEINT) AS budget FROM mix_n3),"""
    for k, level in enumerate(LEVELS):
        keys = LEVELS[:k]
        joined = f"JOIN mix_b{k} USING ({', '.join(keys)})" if keys else "CROSS JOIN mix_b0"
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        cols = ", ".join([*keys, level])
        out += f"""
  mix_r{k} AS (
    SELECT {cols}, cap, w, budget, sum(cap) OVER o AS cum, (sum(w) OVER ({part})) - (sum(w) OVER o) AS rem
    FROM (SELECT {cols}, CAST(cap AS HUGEINT) AS cap, {_weight_sql(plan, level)} AS w, budget FROM mix_n{k + 1} {joined})
    WINDOW o AS ({part} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {level} ROWS UNBOUNDED PRECEDING)
  ),
  mix_f{k} AS (SELECT *, cum * w + cap * rem <= budget * w AS is_full FROM mix_r{k}),
  mix_g{k} AS (
    SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS spent, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) AS left_w
    FROM mix_f{k}
  ),
  mix_b{k + 1} AS (SELECT {cols}, CAST(CASE WHEN is_full THEN cap ELSE (budget - spent) * w // left_w END AS HUGEINT) AS budget FROM mix_g{k}),"""
    return out + f"""
  mix_l AS (
    SELECT domain, lang, source, CAST(total AS BIGINT) AS total, CAST(budget AS BIGINT) AS budget
    FROM mix_n3 JOIN mix_b3 USING (domain, lang, source) WHERE total > 0
  ),
  mix_d AS (
    SELECT doc_id, domain, lang, source, tokens, budget AS leaf_budget, budget // total AS whole, budget % total AS rest,
      md5('{plan.seed}|' || CAST(budget // total AS VARCHAR) || '|' || CAST(doc_id AS VARCHAR)) AS h
    FROM mix_tok JOIN mix_l USING (domain, lang, source)
  ),
  mix_out AS (
    SELECT doc_id, domain, lang, source, tokens, unnest(range(0, whole)) AS epoch, leaf_budget FROM mix_d
    UNION ALL
    SELECT doc_id, domain, lang, source, tokens, whole AS epoch, leaf_budget FROM (
      SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
      FROM mix_d
    ) WHERE lo < rest
  )
"""


ORACLE = f"WITH {mix_sql('documents', PLAN)} SELECT doc_id, domain, lang, source, tokens, epoch, leaf_budget FROM mix_out"
