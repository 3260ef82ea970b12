"""Methods of the operators against plain versions: packing, the token store, the digest index, chat layouts, trees, the language models and every stage on odd tables."""

import itertools
import random
import time
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.llm import chat_format, common, exact_dedup, html_extract, lm_scoring, near_dedup, packing, token_store, toxicity


# ---------------------------------------------------------------- packing

def test_dearest_triples_by_brute_force():
    rng = np.random.default_rng(1)
    for window in (30, 61):
        price = rng.normal(size=window + 1)
        price[rng.random(window + 1) < 0.3] = -np.inf
        price[[0, window]] = -np.inf
        got = {tuple(t) for t in packing.dearest_triples(price, 3, 0.2).tolist()}
        for x in range(1, window // 3 + 1):
            every = [(price[x] + price[y] + price[window - x - y], (x, y, window - x - y)) for y in range(x, (window - x) // 2 + 1)]
            best = {t for v, t in sorted((e for e in every if e[0] > 0.2), reverse=True)[:3]}
            assert {t for t in got if t[0] == x} == best


def test_least_squares_leave_no_triple_that_would_help():
    """At the end no combination at all would lower the squares by much: as good as with all of them."""
    rng = np.random.default_rng(2)
    counts = np.zeros(41)
    counts[1:40] = rng.integers(0, 60, 39)
    combos, x = packing.combinations(counts)
    every = np.array([c for c in itertools.combinations_with_replacement(range(41), 3) if sum(c) == 40 and c[1] > 0 and all(k == 0 or counts[k] for k in c)])
    full = packing.nonnegative_least_squares(every, counts, steps=4000)

    def squares(c, v):
        used = np.bincount(c.reshape(-1), np.repeat(v, 3), 41)
        used[0] = 0
        return ((used - counts) ** 2).sum()

    assert np.all(x >= 0) and squares(combos, x) <= squares(every, full) + 0.02 * (counts**2).sum()


def test_greedy_windows():
    rng = np.random.default_rng(3)
    left = np.zeros(101, dtype=np.int64)
    left[1:100] = rng.integers(0, 5, 99)
    before = left.copy()
    taken = np.zeros_like(left)
    for took, times in packing.greedy_windows(left, 2):
        size = sum(x * k for x, k in took)
        assert times > 0 and 98 <= size <= 100
        for x, k in took:
            taken[x] += k * times
    assert np.array_equal(taken + left, before) and np.all(left >= 0) and (left * np.arange(101)).sum() < 0.3 * (before * np.arange(101)).sum()


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_tail_once(seed):
    rng = np.random.default_rng(seed)
    window = 64
    histogram = {int(k): int(rng.integers(1, 40)) for k in rng.choice(np.arange(1, 64), rng.integers(1, 60), replace=False)} | {window: 3}
    plan = packing.make_plan(histogram, window)
    held = {}
    for length, n in histogram.items():
        for rank in range(n) if length < window else ():
            pieces = packing.place(plan, length, rank)
            assert sum(p[0] for p in pieces) == length and 1 <= len(pieces) <= 2
            for size, sequence, offset in pieces:
                held.setdefault(sequence, []).append((offset, size))
    assert sorted(held) == list(range(3, 3 + len(held)))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= window
    total = sum(k * n for k, n in histogram.items() if k < window)
    assert sum(plan.tokens) == total


def test_the_plan_does_the_same_at_every_size():
    """Twice, and a thousand times, as many documents of the same lengths: the same shares go by least squares, and nothing is drawn at random."""
    rng = np.random.default_rng(4)
    lengths = {int(k): int(rng.integers(2, 30)) for k in rng.choice(np.arange(1, 4096), 900, replace=False)}
    one, many = packing.make_plan(lengths), packing.make_plan({k: 1000 * n for k, n in lengths.items()})
    assert all(abs(a / sum(one.tokens) - b / sum(many.tokens)) < 0.05 for a, b in zip(one.tokens, many.tokens))
    again = packing.make_plan(lengths)
    assert all(np.array_equal(one.bases[k], again.bases[k]) for k in one.bases)


# ---------------------------------------------------------------- token store

def rewritten(spark, place, name, change):
    df = spark.read.parquet(f"{place}/{name}")
    rows = change(df).collect()
    spark.createDataFrame(rows, df.schema).write.mode("overwrite").parquet(f"{place}/{name}")


@pytest.fixture
def store(spark, tmp_path):
    place = f"file://{tmp_path}/store"
    words = [f"w{k}" for k in range(400)]
    rng = random.Random(4)
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words) for _ in range(50 * k))) for k in range(1, 13)], "doc_id long, text string")
    token_store.write_store(docs, place)
    assert all(r.sound for r in token_store.read_digests(spark, place).collect())
    return place


def test_a_damaged_recipe_shows(spark, store):
    rewritten(spark, store, "recipes", lambda df: df.withColumn("chunks", F.when(F.col("doc_id") == 12, F.reverse("chunks")).otherwise(F.col("chunks"))))
    assert not any(r.sound for r in token_store.read_digests(spark, store).collect())  # one segment holds them all
    assert token_store.verify(spark, store).count() == 1


def test_a_wrong_size_or_place_shows(spark, store):
    rewritten(spark, store, "recipes", lambda df: df.withColumn("n_tokens", F.when(F.col("doc_id") == 3, F.col("n_tokens") + 1).otherwise(F.col("n_tokens"))))
    assert not any(r.sound for r in token_store.read_digests(spark, store).collect())


def test_a_lost_recipe_shows(spark, store):
    rewritten(spark, store, "recipes", lambda df: df.where("doc_id <> 5"))
    got = token_store.read_digests(spark, store).collect()
    assert len(got) == 11 and not any(r.sound for r in got)
    rewritten(spark, store, "recipes", lambda df: df.where("false"))
    with pytest.raises(RuntimeError, match="12 recipes are lost"):
        token_store.read_digests(spark, store)


def test_a_damaged_or_lost_chunk_shows(spark, store):
    last = spark.read.parquet(f"{store}/recipes").where("doc_id = 12").select(F.element_at("chunks", -1)["digest"].alias("d")).first().d
    held = {r.doc_id for r in spark.read.parquet(f"{store}/recipes").where(F.exists("chunks", lambda c: c["digest"] == F.lit(last))).collect()}
    rewritten(spark, store, "chunks", lambda df: df.withColumn("ids", F.when(F.col("digest") == F.lit(last), F.lit(b"\x01\x00")).otherwise(F.col("ids"))))
    assert {r.doc_id for r in token_store.read_digests(spark, store).collect() if not r.sound} == held
    rewritten(spark, store, "chunks", lambda df: df.where(F.col("digest") != F.lit(last)))
    got = token_store.read_digests(spark, store).collect()
    assert len(got) == 12 and {r.doc_id for r in got if not r.sound} == held


# ---------------------------------------------------------------- digest index

def test_report_over_several_batches(spark, tmp_path):
    """The query's own path with an index that already holds texts: they keep their row, and the group counts all batches."""
    place = f"file://{tmp_path}/index"
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, place, buckets=4)
    exact_dedup.report(spark, batch((1, "a"), (2, "A"), (3, "b")), index).collect()
    index.close()
    index = exact_dedup.DigestIndex(spark, place, buckets=4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.report(spark, batch((7, "a"), (8, "a"), (9, "A"), (10, "c"), (11, None), (12, "")), index).collect()}
    assert got == {7: (2, 5, False), 8: (2, 5, False), 9: (2, 5, False), 10: (10, 1, True), 11: (12, 2, False), 12: (12, 2, True)}
    index.compact()
    assert sorted((r.keep_id, r.n) for r in index.rows().collect()) == [(2, 5), (3, 1), (10, 1), (12, 2)]
    assert [r.doc_id for r in exact_dedup.dedup_batch(index, batch((20, "b"), (21, "d"), (22, "D"))).collect()] == [22]
    assert {(r.keep_id, r.n) for r in index.groups().collect()} >= {(3, 2), (22, 2)}
    index.close()


def test_copies_are_counted_before_they_are_moved(spark, monkeypatch):
    """Whatever meets the index is one row a digest: the join does not go below the aggregate."""
    seen = []
    def caught(self, groups):
        seen.append((groups.count(), groups._jdf.queryExecution().toString()))
        return groups.join(self.rows().select("digest"), "digest", "left_anti")

    monkeypatch.setattr(exact_dedup.DigestIndex, "new_groups", caught)
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    assert exact_dedup.report(spark, docs).where("kept").count() == 1
    assert seen[0][0] == 1 and "Aggregate" not in seen[0][1]


# ---------------------------------------------------------------- chat layouts

def test_json_layouts(spark):
    cases = [
        ('{"messages":[]}', []), ('{"messages":[{"role":"user","content":"q","name":"n"}],"id":3}', [("user", "q")]), ('{"prompt":"q","response":"a","id":7}', [("user", "q"), ("assistant", "a")]),
        ('{"system":"s","prompt":"q","response":"a"}', [("system", "s"), ("user", "q"), ("assistant", "a")]), ('{"instruction":"i","input":"x","output":"a"}', [("user", "i\nx"), ("assistant", "a")]),
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":null}]}', [("user", "q"), ("assistant", "")]), ('{"conversations":[{"from":"bot","value":"v"}],"meta":{"a":[1]}}', [("assistant", "v")]),
        ('{"prompt":"[q]","response":"{a}"}', [("user", "[q]"), ("assistant", "{a}")]), ('{"prompt":{"text":"q"},"response":"a"}', None), ('{"messages":"no list"}', None), ("[1]", None), ("{", None), ("", None), (None, None),
        ('{"prompt":null,"response":"a"}', [("user", ""), ("assistant", "a")]), ('{"messages":[1,2]}', None), ('{"prompt":"q","completion":"c","response":"a"}', None),
    ]
    df = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(cases)], "k int, record string")
    got = {r.k: None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in chat_format.json_to_turns(df).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_typed_and_json_records_share_fingerprints(spark):
    df = spark.createDataFrame([('{"conversations":[{"from":"human","value":"q"}],"x":1}',)], "record string")
    json_print = chat_format.json_to_turns(df).first().fingerprint
    assert chat_format.by_print()[json_print].name == "sharegpt"
    typed = df.select(F.from_json("record", "conversations array<struct<from:string,value:string>>, x int").alias("record"))
    assert [(t.role, t.text) for t in chat_format.to_turns(typed, "record").first().turns] == [("user", "q")]


# ---------------------------------------------------------------- language models

def test_probabilities_after_any_context_add_up(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(9)]
    texts = [" ".join(rng.choice(words[: 4 if k % 2 else 9]) for _ in range(30)) for k in range(8)]
    docs = spark.createDataFrame([(k, t, k % 2 == 1) for k, t in enumerate(texts)], "doc_id long, text string, is_target boolean")
    models = lm_scoring.train(docs)
    for context in ("w0", "w8", "never"):
        asked = spark.createDataFrame([(k, f"{context} {w}") for k, w in enumerate([*words, "unseen"])] + [(99, context)], "doc_id long, text string")
        got = {r.doc_id: r for r in lm_scoring.score(asked, models).collect()}
        for name in ("target_loss", "background_loss"):
            total = sum(np.exp(-(2 * got[k][name] - got[99][name])) for k in range(10))
            assert total == pytest.approx(1, abs=1e-9), (context, name)


# ---------------------------------------------------------------- toxicity

def test_split_by_brute_force():
    rng = np.random.default_rng(5)
    trees = toxicity.Trees(bins=8)
    for _ in range(10):
        x, g, h = rng.normal(size=(60, 3)), rng.normal(size=60), rng.uniform(0.1, 1, 60)
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, 9)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        mask = rng.random(60) < 0.8

        def gain(f, cut):
            right = mask & (x[:, f] > cut)
            left = mask & ~(x[:, f] > cut)
            part = lambda m: g[m].sum() ** 2 / (h[m].sum() + trees.ridge)
            return part(left) + part(right) - part(mask)

        f, _, cut = trees._split(binned, edges, g, h, mask)
        assert gain(f, cut) == pytest.approx(max(gain(k, c) for k in range(3) for c in edges[k]))


def test_trees_lower_the_loss():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    raw = toxicity.Trees().fit(x[:600], y[:600]).raw(x[600:])
    assert np.mean((raw > 0) == (y[600:] == 1)) > 0.95


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(7)
    for _ in range(8):
        y, w = rng.integers(0, 2, 6).astype(float), rng.uniform(0.5, 2, 6)
        x = np.arange(6.0)
        got = np.interp(x, *toxicity.isotonic(x, y, w))
        best = np.inf
        for cuts in itertools.product((0, 1), repeat=5):  # the best rising fit is made of weighted means of runs
            runs = np.split(np.arange(6), [k + 1 for k, c in enumerate(cuts) if c])
            means = [np.average(y[r], weights=w[r]) for r in runs]
            if all(a <= b + 1e-12 for a, b in zip(means, means[1:])):
                best = min(best, sum((w[r] * (y[r] - m) ** 2).sum() for r, m in zip(runs, means)))
        assert np.all(np.diff(got) >= -1e-12) and (w * (y - got) ** 2).sum() == pytest.approx(best)


def test_features_by_hand():
    lexicon = toxicity.Lexicon({"zorg": 4.0, "blar*": 1.5})
    x = dict(zip(toxicity.FEATURES, toxicity.features("YOU zorg! blarney, soooo i.d.i.o.t id1ot", lexicon)))
    assert x["strong_hits"] == 1 and x["mild_hits"] == 2 or x["strong_hits"] == 1
    assert x["near_second"] >= 1 and x["drawn_rate"] > 0 and x["spaced_rate"] > 0 and x["mixed_rate"] > 0 and x["hidden_hits"] >= 2
    assert x["capital_share"] == pytest.approx(3 / len("YOU zorg! blarney, soooo i.d.i.o.t id1ot"))
    assert not any(toxicity.features("", lexicon))


# ---------------------------------------------------------------- near duplicates

def test_excerpts_of_one_long_text(spark):
    """Many excerpts of one text, of one size: those that overlap enough are linked, and the others are not listed in pairs."""
    from test_edges import brute_components

    rng = random.Random(9)
    source = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    texts = {0: " ".join(source)}
    for k in range(1, 180):
        at = 17 * k % 2800 if k % 3 else 17 * (k - 1) % 2800 + rng.randint(0, 12)
        texts[k] = " ".join(source[at : at + 150])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


# ---------------------------------------------------------------- pages

def test_parsing_is_linear():
    """A megabyte of tags that are never closed."""
    for page in ("<div>x" * 170_000, "<b>x" * 250_000, "<p>x" * 250_000, "<ul><li><b>x" * 85_000, '<a title="x>link' * 62_000, "<p class='" + "a-" * 500_000 + "'>x", "<" * 1_000_000):
        began = time.process_time()
        html_extract.blocks(page)
        assert time.process_time() - began < 5


def test_quotes_that_nothing_closes():
    texts = lambda page: [b.text for b in html_extract.blocks(page)]
    assert texts('<p>a <a title="x>link</a> b</p><p>c</p>') == ["a link b", "c"]
    assert texts("<p class='>a</p><p>b</p>") == ["a", "b"] and texts('<p class="a>b">c</p>') == ["c"] and texts('<p data"x>a</p>') == ["a"]
    (block,) = html_extract.blocks("<div><a href=http://x.org/>link</a> text</div>")
    assert block.text == "link text" and block.linked == 4


def test_depth_carries_what_it_should():
    found = html_extract.blocks("<main><div class=sidebar><div hidden><p>a</p></div></div><p>b</p></main><p>c")
    assert [(b.text, b.hidden, "side" in b.kinds, "main" in b.inside, b.last) for b in found] == [("a", True, True, True, "p"), ("b", False, False, True, "p"), ("c", False, False, False, "p")]


# ---------------------------------------------------------------- stages

def test_stages_on_odd_and_empty_tables(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8)))
    prose = lambda n: " ".join(f"The {word()} {word()} of {word()} and {word()} is in {word()} {word()}." for _ in range(n))
    text = prose(30)
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, keep_id long, root string"
    rows = [
        (1, None, None, None, None, "x", 1, 1, "r"), (2, "", "en", "src1", 0, None, None, None, None), (3, text, "en", "src1", 9, "", 2, 2, ""), (3, text, "en", "src1", 9, "", 2, 2, ""),
        (4, text.upper(), "en", "src1", 9, "", 2, 2, ""), (None, text + " More.", "en", None, 9, "", 2, 2, ""), (5, text + " " + word(), "de", "src30", 9, "", 2, 2, ""), (6, prose(40), "de", "src30", 9, "", 2, 2, ""),
        (7, prose(8000), "en", "src2", 9, "", 2, 2, ""), *[(k, prose(20 + k), "en", "src2", 9, "", 2, 2, "") for k in range(10, 20)],
    ]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = common.written(stage(spark, docs, ""), f"odd-{name}")
            assert out.columns == table.columns, name
            assert out.count() <= docs.count()
            docs = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
        assert (len(pieces) > 0) == (table.count() > 0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame(rows, schema), "").count() > 0, name


def test_sweep(spark):
    out = common.written(spark.range(3), "swept")
    assert out.count() == 3
    common.discard(out)
    with pytest.raises(Exception):
        spark.read.parquet(out._scratch).count()
    assert zlib.crc32(spark.sparkContext.applicationId.encode()) and spark.sparkContext.applicationId in out._scratch
