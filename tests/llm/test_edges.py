"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foresail.llm import chat_format, exact_dedup, html_extract, lm_scoring, mixing, near_dedup, packing, quality_rules, textkit, token_store, toxicity
from foresail.llm.tokenizing import Encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, rep long, m string"
LONG = " ".join(f"word{k % 977} and" for k in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, None, None, None, "x", 1, "m"), (2, "", "en", "src1", 0, None, None, None), (3, " \t\n ", "en", "src1", 4, "", 2, ""),
        (4, "One two", "en", "src2", 7, "", 2, ""), (5, "one TWO", "de", "src2", 7, "", 2, ""), (6, "É é", None, "srcX", 3, "", 2, ""),
        (7, "é é", "fr", "src12", 3, "", 2, ""), (7, "é é", "fr", "src12", 3, "", 2, ""), (8, LONG, "en", "src3", len(LONG), "", 2, ""),
        (None, "no id here", "en", "src3", 10, "", 2, ""), (9, LONG + " end", "en", "src3", len(LONG), "", 2, ""),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(odd, none):
    got = {r.r.doc_id: r for r in quality_rules.judged(odd).collect()}
    assert len(quality_rules.judged(odd).collect()) == 11 and not quality_rules.judged(none).collect()
    assert got[1].m.n_words == got[2].m.n_words == got[3].m.n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[8].m.n_words == 120_000 and got[8].r.digest == ""


def brute_repeats(text):
    words = text.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    seen, out = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            out.update(p + k for p in places for k in range(3))
    return len(out)


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.r.doc_id: r.m.n_repeat_words for r in quality_rules.measures(df).collect()}
    assert got == {k: brute_repeats(t) for k, t in enumerate(texts)}


def test_exact_report(odd, none, spark):
    rows = exact_dedup.report(spark, odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 11 and not exact_dedup.report(spark, none).collect()
    assert by[4].keep_id == by[5].keep_id == 5 and by[4].text_sha256 == hashlib.sha256(b"one two").hexdigest()
    assert by[1].keep_id == 2 and by[1].group_size == 2 and not by[1].kept and by[2].kept
    assert by[6].keep_id == 6 and by[7].group_size == 2 and by[None].keep_id is None


def test_exact_index_is_persistent(spark, tmp_path):
    place = f"file://{tmp_path}/index"
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, place, buckets=4)
    assert sorted(r.doc_id for r in exact_dedup.dedup_batch(index, first).collect()) == [2, 3]
    index.close()
    again = exact_dedup.DigestIndex(spark, place, buckets=4)
    second = spark.createDataFrame([(4, "B"), (5, "c"), (5, "c")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.dedup_batch(again, second).collect()] == [5]
    again.compact()
    assert sorted(r.keep_id for r in again.rows().collect()) == [2, 3, 5]
    plan = again.new_groups(spark.createDataFrame([("x",)], "digest string").groupBy("digest").count())._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    again.close()


def test_exact_batch_keeps_rows_whole(odd, spark):
    out = exact_dedup.dedup_batch(exact_dedup.DigestIndex(spark), odd)
    assert out.columns == odd.columns and sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 3, 5, 6, 7, 8, 9]
    assert out.where("doc_id = 7").count() == 1 and out.where("doc_id = 2").count() == 1


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_of_one_family_by_brute_force(spark):
    """Copies of two texts with 0 to 40 % of the words changed, and a passage that many texts share."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bases = [[word() for _ in range(n)] for n in (150, 60)]
    passage = [word() for _ in range(50)]
    texts = {}
    for d in range(260):
        if d % 3 == 2:
            w = [word() for _ in range(rng.randint(5, 120))] + passage
        else:
            w = list(bases[d % 3])
            for k in range(len(w)):
                if rng.random() < 0.1 * rng.random():
                    w[k] = word()
            if rng.random() < 0.3:
                w = w[: rng.randint(30, len(w))]
        texts[d] = " ".join(w)
    texts |= {300: "", 301: None, 302: "a b", 303: "A  b", 304: "b a", 305: texts[0].upper(), 306: LONG, 307: LONG + " x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_near_edges(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == 11 and not near_dedup.near_duplicates(none).collect()
    by = {r.doc_id: r for r in rows}
    assert by[5].component_id == 4 and not by[5].kept and by[9].component_id == 8 and by[1].kept and by[1].n_shingles == 0
    assert sum(r.doc_id == 7 for r in rows) == 2


def test_signatures_in_the_distance_meet():
    rng = np.random.default_rng(4)
    import pyarrow as pa

    for _ in range(50):
        a = rng.integers(0, 1 << 16, near_dedup.PLACES).astype(np.int32)
        b = a.copy()
        b[rng.choice(near_dedup.PLACES, near_dedup.MAX_DISTANCE, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tolist(), b.tolist()], pa.list_(pa.int32()))], ["rep", "sig"])
        keys = next(near_dedup._keys([batch])).to_pydict()
        half = len(keys["key"]) // 2
        assert set(keys["key"][:half]) & set(keys["key"][half:])


def test_word_hashes_know_words(monkeypatch):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB é\n\t\x1c ") for _ in range(rng.randint(0, 50))) for _ in range(300)]
    for size in (16, 1 << 21):
        monkeypatch.setattr(textkit, "SEGMENT", size)
        hashes, counts = textkit.word_hashes(*textkit.text_bytes(pa.array(texts)))
        words = [w for t in texts for w in t.encode().lower().split()]
        assert counts.tolist() == [len(t.encode().lower().split()) for t in texts]
        table = {}
        assert all(table.setdefault(w, h) == h for w, h in zip(words, hashes.tolist())) and len(set(table.values())) == len(table)


def test_mixing_edges(odd, none):
    rows = mixing.select(odd, mixing.MixPlan(budget_percent=100, max_epochs=1)).collect()
    assert sorted(r.doc_id for r in rows) == [4, 5, 6, 7, 8, 9] and all(r.epoch == 0 for r in rows)
    assert next(r.tokens for r in rows if r.doc_id == 7) == 4
    assert not mixing.select(none, mixing.PLAN).collect()


def test_mixing_shortage_goes_to_siblings_first(spark):
    rows = [(k, "w " * 10, "en", "src1") for k in range(2)] + [(10 + k, "w " * 10, "en", "src2") for k in range(30)] + [(100 + k, "w " * 10, "de", "src11") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    budgets = {r.source: r.budget for r in mixing.leaf_budgets(mixing.token_table(docs), mixing.MixPlan(budget_percent=50, max_epochs=1)).collect()}
    assert budgets == {"src1": 20, "src2": 135, "src11": 155}


def test_chat_edges(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nx"), (2, 0, "a%0A\nb", "<\\|"), (2, 0, "assistant", ""), (3, None, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.formatted(chat_format.to_turns(chat_format.conversations_as_messages(df), "record"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", ""), ("assistant", rows[1][3])] and out[1].loss_text == rows[1][3]
    assert [(t.role, t.text) for t in out[2].turns] == [("a%0A\nb", "<\\|"), ("assistant", "")]
    assert out[3].loss_text == "" and out[3].loss_spans == []
    with pytest.raises(ValueError, match="no mapping"):
        chat_format.to_turns(df.select(F.struct("conv_id").alias("record")), "record")


def test_chat_layouts(spark):
    records = [
        '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}',
        '{"prompt":"q","response":"a"}', '{"prompt":"q","completion":"a"}', '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"","output":"a"}', '{"x":1}', "no json", None,
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(records)], "k int, record string")
    got = {r.k: r.turns and [(t.role, t.text) for t in r.turns] for r in chat_format.json_to_turns(df).collect()}
    assert all(got[k] == [("user", "q"), ("assistant", "a")] for k in range(6)) and got[6] is got[7] is got[8] is None


def test_html():
    crf = html_extract.trained()
    assert html_extract.main_text(None, crf) == html_extract.main_text("", crf) == html_extract.main_text("<script>x</script>", crf) == ""
    held = html_extract.examples(html_extract.labelled_pages(120, seed=5))
    right = np.mean(np.concatenate([crf.decode(x) == y for x, y in held if len(x)]))
    assert right > 0.99
    page = "<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>Some&nbsp;text\n here.<p>More<br>text.</article><div class=comments><p>Nice one, I liked it.</p></div><footer>&copy; x</footer>"
    assert html_extract.main_text(page, crf) == "A & B\nSome text here.\nMore text."


def test_viterbi_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(20):
        f = html_extract.Field(rng.normal(size=(len(html_extract.NAMES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
        x = rng.normal(size=(6, len(html_extract.NAMES)))
        s = x @ f.emit
        best = max(product((0, 1), repeat=6), key=lambda y: f.first[y[0]] + sum(s[t, y[t]] for t in range(6)) + sum(f.move[y[t], y[t + 1]] for t in range(5)))
        assert f.decode(x).tolist() == list(best)


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<p>One &lt; two, said the author.</p>")], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    assert got[:2] == [(1, "", 0), (1, "", 0)] and got[2][2] == len(got[2][1])


def test_lm(odd, none, spark):
    rows = odd.select("doc_id", "text", (F.col("doc_id") == 8).alias("is_target")).fillna(False)
    models = lm_scoring.train(rows, size=512)
    got = {r.doc_id: r for r in lm_scoring.score(odd, models).collect()}
    assert len(got) == 10 and got[1].n_words == 0 and got[1].score == 0 and got[8].score > got[4].score
    empty = lm_scoring.train(none.select("doc_id", "text", F.lit(True).alias("is_target")), size=512)
    assert not lm_scoring.score(none, empty).collect() and np.isfinite(next(r.score for r in lm_scoring.score(odd, empty).where("doc_id = 8").collect()))


def test_lm_counts_by_brute_force(spark):
    texts = ["a b a b c", "b c", "", "c c c a"]
    df = spark.createDataFrame([(k, t, k < 2) for k, t in enumerate(texts)], "doc_id long, text string, is_target boolean")
    m = lm_scoring.train(df, size=16)
    n, (target, background) = m.losses(__import__("pyarrow").array(texts))
    words = {w: {"t": sum(t.split().count(w) for t in texts[:2]), "b": sum(t.split().count(w) for t in texts)} for w in "abc"}

    def loss(text, part, docs):
        total = sum(words[w][part] for w in "abc") + 16
        out, last = 0.0, "^"
        for w in text.split():
            pairs = [p for t in docs for p in zip(["^", *t.split()], t.split())]
            context = sum(p[0] == last for p in pairs)
            weight = lm_scoring.SHARE if context else 0.0
            out -= np.log(weight * pairs.count((last, w)) / max(1, context) + (1 - weight) * (words[w][part] + 1) / total)
            last = w
        return out

    assert n.tolist() == [5, 2, 0, 4]
    assert np.allclose(background, [loss(t, "b", texts) for t in texts], rtol=1e-4) and np.allclose(target, [loss(t, "t", texts[:2]) for t in texts], rtol=1e-4)


def test_lm_counts_every_word_and_bigram(spark):
    """More different words than any table of 65,536 holds, of which each decides a score."""
    from collections import Counter

    rng = random.Random(5)
    docs = [[f"w{1000 * k + j}" for j in range(1000)] for k in range(70)]
    docs += [[f"w{rng.randrange(70_000)}" for _ in range(1000)] for _ in range(30)]
    rows = [(k, " ".join(d), k % 2 == 0) for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, is_target boolean").repartition(3)
    got = {r.doc_id: r for r in lm_scoring.score_trained(lm_scoring.train(df, asks=True)).collect()}
    again = {r.doc_id: r for r in lm_scoring.score(df, lm_scoring.train(df)).collect()}
    size = len({w for d in docs for w in d}) + 1
    want = []
    for part in (docs[::2], docs):
        words, contexts, pairs = Counter(), Counter(), Counter()
        for d in part:
            words.update(d)
            contexts.update(["^", *d[:-1]])
            pairs.update(zip(["^", *d], d))
        total = sum(words.values()) + size
        weight = lambda c: lm_scoring.SHARE if contexts[c] else 0.0
        want.append([-np.mean([np.log(weight(p[0]) * pairs[p] / max(contexts[p[0]], 1) + (1 - weight(p[0])) * (words[p[1]] + 1) / total) for p in zip(["^", *d], d)]) for d in docs])
    assert len(got) == len(again) == 100
    for found in (got, again):
        assert np.allclose([found[k].target_loss for k in range(100)], want[0]) and np.allclose([found[k].background_loss for k in range(100)], want[1])


def test_lm_writes_its_chunks_and_nothing_else(spark, monkeypatch):
    """Totals come with the answers of all buckets, also to a chunk that has words in few of them."""
    names = []
    keep = lm_scoring.written
    monkeypatch.setattr(lm_scoring, "written", lambda df, name, *rest: names.append(name) or keep(df, name, *rest))
    df = spark.createDataFrame([(k, f"a b w{k}", k == 0) for k in range(3)], "doc_id long, text string, is_target boolean").repartition(3, "doc_id")
    got = {r.doc_id: r for r in lm_scoring.score_trained(lm_scoring.train(df, asks=True)).collect()}
    assert names == ["lm-chunks"]
    # Nine words, five of them different. A first word and a "b" after "a" are certain, each last word follows "b" in a third.
    total = 9 + 5 + 1
    want = [0.6 + 0.4 * 4 / total, 0.6 + 0.4 * 4 / total, 0.6 / 3 + 0.4 * 2 / total]
    assert all(got[k].background_loss == pytest.approx(-np.mean(np.log(want))) for k in range(3))


def test_lm_chunks_of_long_texts(spark):
    """A chunk closes at its size, however long the texts of a batch are."""
    texts = [" ".join(f"w{(7 * k + j) % 1013}{k}" for j in range(400_000)) for k in range(7)]
    df = spark.createDataFrame([(k, t, k < 3) for k, t in enumerate(texts)], "doc_id long, text string, is_target boolean").coalesce(1)
    models = lm_scoring.train(df, asks=True)
    assert models.parts.count() == 3
    got = lm_scoring.score_trained(models).collect()
    assert sorted((r.doc_id, r.n_words) for r in got) == [(k, 400_000) for k in range(7)]
    cuts = list(lm_scoring._cuts(np.cumsum([0, 0, 5, lm_scoring.PART_BYTES, lm_scoring.PART_BYTES + 9, 1, 0])))
    assert cuts == [(0, 2), (2, 3), (3, 4), (4, 6)]


def test_encoder_asks_for_a_word_once():
    e = Encoder(vocabulary_path())
    asked = []
    ask = e._ask
    e._ask = lambda texts, *which: asked.extend(texts) or ask(texts, *which)
    texts = ["Stemword*** stemword... stemword,\n(stemword) ÉTÉ", None, "", "stemword&&&  日本 stemword STEMWORD?!", "<|stemword"]
    want = [x.ids + [2] for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.ended(pa.array(texts))] == want
    assert sorted(w for t in asked for w in t.split() if "stemword" in w) == ["(stemword)", "<|stemword", "stemword", "stemword"]  # the last is STEMWORD beyond Latin-1
    assert [x.tolist() for x in e.ended(pa.array(["x", *texts])[1:])] == want


def test_marks_in_little_memory():
    ids = np.random.default_rng(3).integers(0, 49_000, 400_001).astype(np.uint16)
    tracemalloc.start()
    got = token_store.marks(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3_000_000
    sums = np.zeros(len(ids), np.uint64)
    for back in range(token_store.WINDOW):
        sums[back:] += token_store._GEAR[ids[: len(ids) - back]] * np.uint64(pow(0x9E3779B97F4A7C15, back, 1 << 64))
    assert got.tolist() == (np.flatnonzero(sums >> np.uint64(56) == 0) + 1).tolist()


def test_encoder_equals_the_library():
    e = Encoder.of(vocabulary_path())
    rng = random.Random(6)
    alphabet = "aAbBzZ ÉéßÀ .,;:!?'s 12\n\t\r\x0b\x1c\x01\xa0 ΣσςİıŁ日本é̈<|>endoftext-_@#"
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "I'll.", "ΑΣ", "İ.", "!."]
    texts = ["".join(rng.choice(alphabet) if rng.random() < 0.8 else rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    want = [x.ids + [2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in e.ended(texts)] == want


@pytest.mark.parametrize("kept", [0, 7, 400])
def test_encoder_forgets_and_learns_again(kept, monkeypatch):
    e = Encoder(vocabulary_path())
    rng = random.Random(kept)
    words = [*("".join(rng.choice("abcxyzéÀ") for _ in range(rng.randint(1, 12))) for _ in range(300)), "a" * 65, "é" * 70, "x\x01y", "12", "don't", "日本", "a×b", "a-b.", "µ,", "(c)"]
    texts = [None, "", " "] + [" ".join(rng.choice(words) + rng.choice(["", "", ",", "...", "'", "!?"]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    want = [x.ids + [2] for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    monkeypatch.setattr("foresail.llm.tokenizing.KEPT", kept)
    monkeypatch.setattr("foresail.llm.tokenizing.RUN", 3000)
    monkeypatch.setattr("foresail.llm.tokenizing.BLOCK", 700)
    for _ in range(2):
        assert [x.tolist() for x in e.ended(texts)] == want
        assert len(e.kept) == len(e.codes) <= kept and max(map(len, e.kept.to_pylist()), default=0) <= 64


def test_pieces_of_many_batches_are_looked_up_once(monkeypatch):
    seen = []
    known = Encoder._known
    monkeypatch.setattr(Encoder, "_known", lambda self, column: seen.extend(column.to_pylist()) or known(self, column))
    texts = [f"Word{mark} wordé{mark} (word)\n WORD" for mark in (",", ".", "", "?!") for _ in range(700)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    out = list(token_store._staging(vocabulary_path())(iter(batches)))
    assert [x for b in out for x in b.column(0).to_pylist()] == list(range(len(texts))) and [len(b) for b in out] == [1000, 1000, 800]
    assert sorted(x for x in seen if x) == sorted(["word", "wordé", "(word)", ",", ".", "?!"])


def test_token_store_writes_few_scratch_tables(odd, spark, tmp_path, monkeypatch):
    names = []
    written = token_store.written
    monkeypatch.setattr(token_store, "written", lambda df, name, *rest: names.append(name) or written(df, name, *rest))
    place = f"file://{tmp_path}/store"
    token_store.write_store(odd, place)
    assert token_store.read_digests(spark, place).where("NOT sound").count() == 0
    assert names == ["tokens", "ranges", "range-totals", "segment-roots"]
    assert not list((tmp_path / "store").glob("*/.*.parquet.crc"))


def test_chunk_that_is_not_its_digest_is_told():
    ids = np.arange(9, dtype="<u2").tobytes()
    rows = pa.RecordBatch.from_arrays([pa.array([token_store.digest(ids), token_store.digest(ids), token_store.digest(b"")], pa.binary()), pa.array([ids, ids[2:], b""], pa.binary())], ["digest", "ids"])
    for batch in (rows, rows.slice(1)):
        got = pa.Table.from_batches(token_store._checked("<u2")([batch])).to_pylist()
        want = [(9, zlib.crc32(np.arange(9, dtype="<u4").tobytes()), True), (8, zlib.crc32(np.arange(1, 9, dtype="<u4").tobytes()), False), (0, 0, True)]
        assert [(r["stored_n"], r["crc"], r["sound"]) for r in got] == want[3 - len(batch) :]


def test_token_store_round_trip(odd, none, spark, tmp_path):
    place = f"file://{tmp_path}/store"
    token_store.write_store(odd, place)
    e = Encoder.of(vocabulary_path())
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = [x for x in e.ended([r.text for r in rows])]
    got = sorted(token_store.read_digests(spark, place).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in rows] and all(r.sound for r in got)
    assert [(r.start, r.n_tokens, r.ids_crc32) for r in got] == [(sum(map(len, ids[:k])), len(x), zlib.crc32(x.astype("<u4").tobytes())) for k, x in enumerate(ids)]
    assert {r.start: r.ids for r in token_store.read_documents(spark, place).collect()} == {sum(map(len, ids[:k])): x.tolist() for k, x in enumerate(ids)}
    assert not token_store.verify(spark, place).collect()
    broken = spark.read.parquet(f"{place}/recipes").withColumn("chunks", F.reverse("chunks")).collect()
    spark.createDataFrame(broken, spark.read.parquet(f"{place}/recipes").schema).write.mode("overwrite").parquet(f"{place}/recipes")
    assert token_store.verify(spark, place).collect()
    token_store.write_store(none, f"{place}-none")
    assert not token_store.read_digests(spark, f"{place}-none").collect()


def test_shared_passages_are_stored_once():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 49_000, 6000).astype("<u2")
    a, b = (np.concatenate((rng.integers(0, 49_000, n).astype("<u2"), passage)) for n in (700, 1900))
    chunks = [{x[s:e].tobytes() for s, e in zip([0, *token_store.cuts(x)], token_store.cuts(x))} for x in (a, b)]
    assert sum(map(len, chunks[0] & chunks[1])) / 2 > 4500
    assert token_store.crc_join(zlib.crc32(b"ab"), zlib.crc32(b"cde"), 3) == zlib.crc32(b"abcde")


def test_shingles_of_long_texts_in_little_memory():
    rng = random.Random(9)
    words = [f"{rng.getrandbits(24):x}" for _ in range(5000)]
    texts = [" ".join(rng.choices(words, k=n)) for n in [0, 3, *[40_000] * 60, 500_000, 7, 40_000]]
    column = pa.array([None, *texts])
    want = [next(textkit.shingle_sets(pa.array([t], pa.string()))).tolist() for t in texts]
    tracemalloc.start()
    assert all(x.tolist() == w for x, w in zip(textkit.shingle_sets(column[1:]), want, strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    assert next(textkit.shingle_sets(column)).tolist() == []


def test_crcs_of_many_messages_are_joined_at_once():
    rng = random.Random(8)
    messages = [[rng.randbytes(rng.choice([0, 4, 260, 8192])) for _ in range(rng.randint(0, 9))] for _ in range(300)] + [[b"abcd"] * 40_000]
    parts = [p for m in messages for p in m]
    ends = np.cumsum([0, *map(len, messages)])
    got = token_store.crcs_joined(np.array([zlib.crc32(p) for p in parts]), np.array(list(map(len, parts))), ends)
    assert got.tolist() == [zlib.crc32(b"".join(m)) for m in messages]
    assert token_store.crcs_joined(np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([0, 0])).tolist() == [0]


def check_pieces(rows, texts, window):
    e = Encoder.of(vocabulary_path())
    ids = [x.tolist() for x in e.ended(texts)]
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= window
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(r.length for r in rows) == sum(map(len, ids))
    # Each document's pieces in order have the crc32 of its ids; documents are told by size and first piece where ids repeat.
    whole = {}
    for x in e.ended(texts):
        whole.setdefault(len(x), []).append(x)
    for (_, size), parts in by_doc.items():
        parts.sort(key=lambda r: r.start)
        found = [x for x in whole[size] if all(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].astype("<u4").tobytes()) for r in parts)]
        assert found and sum(r.length for r in parts) % size == 0
    return sum(map(len, ids)) / (window * len(by_seq))


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(odd, none, spark, window):
    rows = packing.pack(odd, window=window).collect()
    check_pieces(rows, [r.text for r in odd.collect()], window)
    long = np.array(list(Encoder.of(vocabulary_path()).ended([LONG]))[0])
    for r in rows:
        if r.doc_id == 8:
            assert r.ids_crc32 == zlib.crc32(long[r.start : r.start + r.length].astype("<u4").tobytes())
    assert not packing.pack(none, window=window).collect()


def test_packing_fills(spark):
    rng = random.Random(2)
    texts = [" ".join(["the"] * rng.choice([7, 7, 7, 20, 30, 41, 55, 62])) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = packing.pack(df, window=64).collect()
    assert check_pieces(rows, texts, 64) > 0.99
    sequences = packing.sequences(df, packing.pack(df, window=64), window=64).collect()
    assert all(len(r.ids) in (1, 2, 4, 8, 16, 32, 64) for r in sequences)


def test_least_squares_meets_an_exact_histogram():
    counts = np.zeros(65)
    counts[[10, 54, 20, 24]] = 30, 30, 80, 40
    combos, x = packing.combinations(counts)
    used = np.bincount(combos.reshape(-1), np.repeat(x, 3), 65)
    used[0] = 0
    assert np.allclose(used, counts, atol=0.5) and {tuple(c) for c in combos.tolist()} >= {(10, 54, 0), (20, 20, 24)}


def test_toxicity(odd, none, spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for d in range(1200):
        toxic = d % 4 == 0
        w = [word() for _ in range(60)]
        for _ in range(4 if toxic else 0):
            w.insert(rng.randint(0, 60), rng.choice(("idiot", "zzqqa" + word(), "kkvvu" + word())))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (5000, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out for d in held) and np.mean([got[d].predicted == (d % 4 == 0) for d in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(odd, model).count() == 11
    nothing = toxicity.fit(none, none.selectExpr("doc_id", "cast(null as int) toxic"))
    assert {r.score for r in toxicity.score(odd, nothing).collect()} == {0.5}


def test_letters_parted_by_blanks_only():
    lexicon = toxicity.Lexicon({})
    at = toxicity.FEATURES.index("spaced_rate")
    assert toxicity.features("you i d i o t", lexicon)[at] > 0 and toxicity.features("you i.d.i.o.t", lexicon)[at] > 0
    assert toxicity.features("a plain text", lexicon)[at] == 0


def test_script_with_a_less_than_sign():
    page = "<p>Before.</p><script>for(i=0;i<n;i++){f(i)}</script><p>Between.</p><SCRIPT>if (a<b) {'</p>'}</SCRIPT ><p>After.</p><style>never closed<p>No."
    assert [b.text for b in html_extract.blocks(page)] == ["Before.", "Between.", "After."]


def test_isotonic_rises():
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.5])
    knots = toxicity.isotonic(x, np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert np.allclose(np.interp(x, *knots), [0, 0.5, 0.5, 1, 1])
