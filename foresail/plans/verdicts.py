"""What a run's score tables say: answers to the standing questions, the exit decision and the criteria behind it, a row a series.

Every answer is a DataFrame program over score tables of one model window, so a panel of any number of series is judged at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scoring

# The level of all tests, the gain over the base that calls for an audit, the fewest effective trials that say something,
# the shares of folds from which residual tests mean yes and up to which they mean no, the share of folds that settles a transform, and the sub-periods that count as stable.
ALPHA, LEAK_GAIN, INFORMATIVE, SHARE_YES, SHARE_NO, SETTLED, STABLE = 0.05, 0.30, 10, 0.5, 0.10, 0.9, 3
DECISION = {"proceed": "GO", "proceed, restricted": "GO, restricted", "stop modelling": "NO-GO", "leakage audit": "AUDIT FIRST", "no decision": "NO DECISION"}


def primary_window(windows: tuple[str, ...] | list[str]) -> str:
    return "expanding" if "expanding" in windows else list(windows)[0]


def chosen(store: DataFrame) -> DataFrame:
    """unique_id, window, candidate, interval_model: the best candidate on dev, and the best that has intervals."""
    ranked = scoring.candidate_ranking(store)
    first = F.min_by("model", "rank")
    return ranked.groupBy("unique_id", "window").agg(first.alias("candidate"), F.min_by(F.when(F.col("has_intervals"), F.col("model")), F.when(F.col("has_intervals"), F.col("rank"))).alias("interval_model"))


def _answers(df: DataFrame, question: str, answer: Column, detail: Column) -> DataFrame:
    return df.select("unique_id", "window", F.lit(question).alias("question"), answer.alias("answer"), detail.alias("detail"))


def _of(rows: DataFrame, choice: DataFrame, who: str) -> DataFrame:
    """Rows of each series' chosen model; a series without rows has one of nulls."""
    key = ["unique_id", "window"] if "window" in rows.columns else ["unique_id"]
    found = choice.select("unique_id", "window", F.col(who).alias("model")).where("model IS NOT NULL")
    return choice.select("unique_id", "window").join(rows.join(found, [*key, "model"]), ["unique_id", "window"], "left")


def beats_reference(point: DataFrame, choice: DataFrame) -> DataFrame:
    """Whether the candidate beats the reference at all, some or none of the horizons that could be tested, at adjusted significance."""
    rows = _of(point, choice, "candidate").groupBy("unique_id", "window").agg(
        F.count("dm_p_better_holm").alias("n"), F.count_if((F.col("rel_mae") < 1) & (F.col("dm_p_better_holm") < ALPHA)).alias("wins"), F.max("model").alias("model")
    )
    answer = F.when(F.col("model").isNull(), "not answerable").when(F.col("n") == 0, "not testable").when(F.col("wins") == F.col("n"), "yes").when(F.col("wins") > 0, "partly").otherwise("no")
    return _answers(rows, "RQ1", answer, F.concat_ws(" ", "model", F.lit("wins at"), "wins", F.lit("of"), "n", F.lit("tested horizons")))


def reach(h_star: DataFrame, skill: DataFrame, choice: DataFrame) -> DataFrame:
    """How far ahead the candidate has skill."""
    first = skill.groupBy("unique_id", "window", "model").agg(F.min_by(F.struct("skill", "lo", "hi"), "h").alias("s"))
    rows = _of(h_star.join(first, ["unique_id", "window", "model"], "left"), choice, "candidate")
    answer = F.when(F.col("h_star").isNull(), "not answerable").otherwise(F.concat(F.lit("h* = "), F.col("h_star").cast("string")))
    return _answers(rows, "RQ2", answer, F.concat_ws(" ", "model", F.lit("first skill"), F.format_string("%.2f [%.2f, %.2f]", "s.skill", "s.lo", "s.hi")))


def covers(buckets: DataFrame, choice: DataFrame) -> DataFrame:
    """Whether intervals hold what they say, in the buckets of horizons with enough effective trials."""
    informative = F.floor("n_eff") >= INFORMATIVE
    low = informative & ((F.col("coverage") < F.col("band_lo")) | ((F.col("kupiec_p") < ALPHA) & (F.col("coverage") < F.col("level"))))
    high = informative & ((F.col("coverage") > F.col("band_hi")) | ((F.col("kupiec_p") < ALPHA) & (F.col("coverage") > F.col("level"))))
    name = F.concat(F.col("bucket"), F.lit(" "), F.format_string("%.0f%% (%.0f%%)", F.col("level") * 100, F.col("coverage") * 100))
    rows = _of(buckets, choice, "interval_model").groupBy("unique_id", "window").agg(
        F.count_if(informative).alias("n"), F.count_if(low).alias("under"), F.count_if(high).alias("over"), F.array_join(F.array_sort(F.collect_list(F.when(low | high, name))), "; ").alias("where")
    )
    answer = F.when(F.col("n") == 0, "not answerable").when((F.col("under") == 0) & (F.col("over") == 0), "calibrated").when(F.col("over") == 0, "under-covers").when(F.col("under") == 0, "over-covers").otherwise("miscalibrated")
    return _answers(rows, "RQ3", answer, F.col("where"))


def _level(share: Column) -> Column:
    return F.when(share.isNull(), "n/a").when(share > SHARE_YES, "yes").when(share <= SHARE_NO, "no").otherwise("mixed")


def residuals(summary: DataFrame, choice: DataFrame) -> DataFrame:
    """Whether the candidate's residuals are autocorrelated and whether their size clusters."""
    rows = _of(summary, choice, "candidate")
    linear = F.greatest("lb_reject_share", "lb_2m_reject_share")
    answer = F.when(F.col("model").isNull(), "not answerable").otherwise(F.concat(F.lit("autocorrelation "), _level(linear), F.lit(", ARCH "), _level(F.col("arch_reject_share"))))
    return _answers(rows, "RQ4", answer, F.format_string("rejects at %.0f%% and %.0f%% of folds", linear * 100, F.col("arch_reject_share") * 100))


def windows_and_time(gap: DataFrame, subperiods: DataFrame, choice: DataFrame) -> DataFrame:
    """Whether a short memory is better, and whether the candidate's gain lasts over the sub-periods."""
    rows = _of(gap.drop("window"), choice, "candidate").groupBy("unique_id", "window").agg(
        F.count("ratio").alias("n"), F.count_if((F.col("ratio") < 1) & (F.col("p_rolling_better_holm") < ALPHA)).alias("r"), F.count_if((F.col("ratio") > 1) & (F.col("p_expanding_better_holm") < ALPHA)).alias("e")
    )
    held = _of(subperiods, choice, "candidate").where("h IS NOT NULL").groupBy("unique_id", "window", "h").agg(F.count_if(F.col("rel_mae") < 1).alias("wins"), F.count(F.lit(1)).alias("blocks"))
    said = held.groupBy("unique_id", "window").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("h = %03d: %d of %d", "h", "wins", "blocks"))), "; ").alias("held"))
    answer = F.when(F.col("n") == 0, "not answerable").when(F.col("r") > 0, "rolling wins").when(F.col("e") > 0, "stable").otherwise("no significant gap")
    return _answers(rows.join(said, ["unique_id", "window"], "left"), "RQ5", answer, F.coalesce("held", F.lit("")))


def transforms(counts: DataFrame, choice: DataFrame, configured: str) -> DataFrame:
    """Which transform the folds chose; one of them is settled if nearly all of them agree."""
    top = counts.groupBy("unique_id").agg(F.max_by(F.struct("family", "n", "share"), F.struct(F.col("n"), F.col("share"))).alias("t"))
    rows = choice.select("unique_id", "window").join(top, "unique_id", "left")
    chose = F.when(F.col("t.share") >= SETTLED, F.col("t.family")).otherwise("mixed")
    answer = F.when(F.col("t").isNull(), "not applicable").when(F.lit(configured != "auto"), f"{configured} (configured)").otherwise(chose)
    return _answers(rows, "RQ6", answer, F.concat_ws(" ", "t.family", F.lit("in"), "t.n", F.lit("folds")))


def exit_decision(point: DataFrame, first: DataFrame, returns: bool) -> DataFrame:
    """What follows from the answers ``first`` to the first question: an error that is too small is looked into before anything else."""
    key = ["unique_id", "window"]
    base = point.where("model = 'ets'").select(*key, "h", F.col("mae").alias("base"), F.lit("ets").alias("of"))
    if returns:
        own = point.where(F.col("model") == F.col("reference")).select(*key, "h", F.col("mae").alias("base"), F.lit("the reference").alias("of"))
        base = base.unionByName(own.join(base.select(*key).distinct(), key, "left_anti"))
    others = point.where(~scoring.is_baseline(F.col("model")) & (F.col("model") != "ets"))
    gains = others.join(base, [*key, "h"]).withColumn("ratio", F.try_divide("mae", "base")).groupBy(*key).agg(F.min_by(F.struct("ratio", "model", "h", "of"), "ratio").alias("g"))
    rows = first.where("question = 'RQ1'").select(*key, F.col("answer").alias("said")).join(gains, key, "left")
    answer = (
        F.when(F.col("g.ratio") < 1 - LEAK_GAIN, "leakage audit").when(F.col("said") == "yes", "proceed").when(F.col("said") == "partly", "proceed, restricted")
        .when(F.col("said").isin("no", "not testable"), "stop modelling").otherwise("no decision")
    )
    detail = F.when(F.col("g.ratio") < 1 - LEAK_GAIN, F.format_string("%s is %.0f%% better than %s at h = %d", "g.model", (1 - F.col("g.ratio")) * 100, "g.of", "g.h")).otherwise("")
    return _answers(rows, "exit", answer, detail)


def criteria(point: DataFrame, buckets: DataFrame, subperiods: DataFrame, h_star: DataFrame, answers: DataFrame, choice: DataFrame, coverage: dict[float, tuple[float, float]], below: float = 1.0, blocks: int = STABLE) -> DataFrame:
    """unique_id, window, criterion, result: accuracy up to h*, calibration within ``coverage`` (bounds by level) and stability, as pass, partial, fail or n/a; and the decision of the exit row."""
    key = ["unique_id", "window"]
    said = answers.groupBy(*key).pivot("question", ["RQ1", "exit"]).agg(F.first("answer"))
    far = _of(h_star, choice, "candidate").select(*key, "h_star")
    near = _of(point, choice, "candidate").join(far, key).where(F.col("h") <= F.greatest(F.col("h_star"), F.lit(1))).groupBy(*key).agg((F.bool_and(F.coalesce(F.col("rel_mae") < below, F.lit(False))) & (F.max("h_star") >= 1)).alias("below"))
    rows = choice.select(*key, "candidate", "interval_model").join(said, key, "left").join(near, key, "left")
    accuracy = F.when(F.col("candidate").isNull() | F.col("below").isNull(), "n/a").when(F.col("below") & (F.col("RQ1") == "yes"), "pass").when(F.col("below") | F.col("RQ1").isin("yes", "partly"), "partial").otherwise("fail")
    limit = F.lit(None).cast("array<double>")
    for level, bounds in coverage.items():
        limit = F.when(F.round("level", 2) == level, F.array(*map(F.lit, map(float, bounds)))).otherwise(limit)
    judged = _of(buckets, choice, "interval_model").withColumn("_l", limit).groupBy(*key).agg(
        F.count("level").alias("have"), F.count_if(F.floor("n_eff") >= INFORMATIVE).alias("n"),
        F.count_if((F.floor("n_eff") >= INFORMATIVE) & F.col("_l").isNotNull() & ~F.col("coverage").between(F.get("_l", F.lit(0)), F.get("_l", F.lit(1)))).alias("out"),
    )
    calibrated = F.when(F.coalesce("have", F.lit(0)) == 0, "n/a").when(F.col("n") == 0, "not judged").when(F.col("out") == 0, "pass").otherwise("fail")
    held = _of(subperiods, choice, "candidate").where("h IS NOT NULL").groupBy(*key, "h").agg(F.count_if(F.col("rel_mae") < 1).alias("wins")).groupBy(*key).agg((F.min("wins") >= blocks).alias("held"))
    stable = F.when(F.col("held").isNull(), "n/a").when(F.col("held"), "pass").otherwise("fail")
    decision = F.lit(None).cast("string")
    for k, v in DECISION.items():
        decision = F.when(F.col("exit") == k, v).otherwise(decision)
    all_ = rows.join(judged, key, "left").join(held, key, "left")
    each = F.array(*[F.struct(F.lit(n).alias("criterion"), c.alias("result")) for n, c in (("1 accuracy", accuracy), ("3 calibration", calibrated), ("5 stability", stable), ("decision", decision))])
    return all_.select(*key, F.explode(each).alias("c")).select(*key, "c.criterion", "c.result")


def beats(pairs: DataFrame, horizons: tuple[int, ...], max_h: int, alpha: float = ALPHA) -> DataFrame:
    """unique_id, window, model, h, n, rel_mae, p_better, p_holm, hit: every model against one baseline (pairs as of ``scoring.paired``), adjusted over all models and horizons of a series."""
    rows = pairs.where((F.col("model") != F.col("reference")) & F.col("h").isin(*horizons))
    tested = scoring.diebold_mariano(rows, scoring.CELL, max_h).where("dm_p_better IS NOT NULL").withColumnRenamed("dm_p_better", "p_better")
    return scoring.holm(tested, "p_better", ["unique_id", "window"], "p_holm").select(*scoring.CELL, "n", "rel_mae", "p_better", "p_holm", (F.col("p_holm") < alpha).alias("hit"))
