"""Scratch tables and the mixing stage: what is written, what is shuffled."""

import glob

from pyspark.sql import functions as F

from foresail.llm import common, components, mixing, near_dedup

SMALL = "/root/testdata/sf0.001"


def test_stage_mixing_leaves_texts_where_they_lie(spark):
    """The rows are those whose id the mixture holds, also of ids in several leaves, and no text is shuffled."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    doubled = docs.where("doc_id % 3 = 0").withColumns({"source": F.lit("src98"), "lang": F.lit(None).cast("string"), "text": F.concat("text", F.lit(" again"))})
    nameless = docs.limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    docs = common.written(docs.unionByName(doubled).unionByName(nameless), "test-docs")
    taken = {r.doc_id for r in mixing.select(docs, mixing.PIPELINE_PLAN).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        out = mixing.stage_mixing(spark, docs, SMALL)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning" not in plan
    want = [tuple(r) for r in docs.collect() if r.doc_id in taken]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and 0 < len(want) < docs.count() - 5


def test_scratch_tables_have_no_checksum_files(spark):
    """A file beside each part would cost an executor one more process to start."""
    df = common.written(spark.range(100).repartition(3), "test-plain")
    folder = df._scratch.removeprefix("file:").replace("///", "/")
    assert df.count() == 100 and len(glob.glob(f"{folder}/part-*")) == 3 and not glob.glob(f"{folder}/.*.crc")


def test_parted_keys_are_dealt_anew(spark):
    """A join with an aggregate by the same key has plain exchanges on both sides, so that a hot key can be split, without a table between."""
    rows = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    sums = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    joined = rows.join(common.parted(sums, "k").hint("merge"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and joined.where("n IN (714, 715)").count() == 5000
    assert dict(joined.dtypes)["k"] == "bigint"


def test_near_duplicates_write_what_is_read_twice(spark, monkeypatch):
    """Scratch tables of a run with both rounds of links."""
    names = []
    for module in (near_dedup, components):
        monkeypatch.setattr(module, "written", lambda df, name, *a: names.append(name) or common.written(df, name, *a))
    near_dedup.near_duplicates(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")).count()
    assert not {"near-shared", "near-weights", "near-leads", "near-split", "least"} & set(names)
    assert names.count("near-held") == 1
