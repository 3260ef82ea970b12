"""The whole pipeline on a small table against a plain version of its stages."""

import duckdb
import pyarrow as pa

import corpus_pipeline
from foresail.llm import mixing, quality_rules
from test_edges import brute_components, check_pieces

SMALL = "/root/testdata/sf0.001"


def test_pipeline_by_brute_force(spark):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    kept = [r[0] for r in con.execute(f"SELECT doc_id FROM ({quality_rules.ORACLE}) WHERE kept").fetchall()]
    rows = {r[0]: r for r in con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall() if r[0] in set(kept)}
    best = {}
    for d, r in rows.items():
        key = "".join(c.lower() if c.isascii() else c for c in r[1] or "")
        best[key] = max(best.get(key, d), d)
    exact = {d: rows[d] for d in best.values()}
    parts = brute_components({d: r[1] for d, r in exact.items()})
    near = {d: r for d, r in exact.items() if parts[d][1] == d}
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    left = pa.table({n: [r[k] for r in near.values()] for k, n in enumerate(names)})
    con.register("remaining", left)
    mixed = {r[0] for r in con.execute(f"WITH {mixing.mix_sql('remaining', mixing.PIPELINE_PLAN)} SELECT doc_id FROM mix_out").fetchall()}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == mixed and 0 < len(mixed) < len(near) < len(exact) <= len(kept) < 200
    assert check_pieces(got, [near[d][1] for d in sorted(mixed)], 4096) > 0.9


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns, name
