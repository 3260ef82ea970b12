"""Near-duplicate detection: b-bit MinHash signatures under a multi-index Hamming join.

A signature is 64 min-hashes of 16 bits, and its distance is the number of places that
differ. It is split into 16 chunks of 4 places. Two signatures that differ in at most 31
places differ in at most one place of some chunk (31 < 16 * 2), so both hold an equal key
when each chunk's keys leave out one place in turn: every such pair meets, none is left
to chance. Pairs that meet are held against the distance, then against the full shingle sets.

Equal shingle sets are one class from the start, and a pair inside one component is not
looked at again, so a group of thousands of copies costs links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, parted, ship, table, written
from .components import components
from .textkit import mix, shingle_sets

PLACES, BITS, CHUNKS = 64, 16, 16
WIDTH = PLACES // CHUNKS
MAX_DISTANCE = 2 * CHUNKS - 1
PERCENT = 75
COMMON = 64  #: a shingle that more of a family hold counts as inside
_RNG = np.random.Generator(np.random.PCG64(75))
_XOR = _RNG.integers(0, 1 << 63, PLACES, dtype=np.uint64)
_ODD = _RNG.integers(1, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 places of 16 bits; in pieces, so that a text of any length needs little memory."""
    low = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        np.minimum(low, ((h[None, :] ^ _XOR[:, None]) * _ODD[:, None]).min(axis=1), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.int32)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sizes, a, b, sigs, places = [], [], [], [], [0]
            for h in shingle_sets(part.column(1)):
                sizes.append(len(h))
                a.append(int(h.sum(dtype=np.uint64).astype(np.int64)) if len(h) else 0)
                b.append(int(np.bitwise_xor.reduce(mix(h)).astype(np.int64)) if len(h) else 0)
                if len(h):
                    sigs.append(signature(h))
                places.append(len(sigs) * PLACES)
            values = pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), values)],
                ["doc_id", "n_shingles", "set_a", "set_b", "sig"],
            )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the shingle set, and the signature, of (doc_id, text)."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sign, SIGNED)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sig = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(n, CHUNKS, WIDTH)
        chunk = np.arange(CHUNKS, dtype=np.uint64)[None, :]
        keys = np.empty((n, CHUNKS, WIDTH), dtype=np.uint64)
        for out in range(WIDTH):
            k = chunk * np.uint64(WIDTH) + np.uint64(out)
            for place in range(WIDTH):
                if place != out:
                    k = (k << np.uint64(BITS)) | sig[:, :, place]
            keys[:, :, out] = k
        doc = batch.column(0).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(doc, CHUNKS * WIDTH))], ["key", "rep"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full shingle sets reach the similarity."""
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            keep = []
            for x, y in zip(shingle_sets(part.column(2)), shingle_sets(part.column(3))):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(both) and 100 * both >= PERCENT * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], ["a", "b"])


def _close(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) within the signature distance."""
    far = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda s, x: s + x)
    with_a = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    both = with_a.join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.where(far <= MAX_DISTANCE).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose whole texts (doc_id, text) agree."""
    pairs = written(pairs, "near-pairs")
    by_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = by_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    out = written(rows.select("a", "b", "text_a", "text_b").mapInArrow(_agreeing, "a long, b long"), "near-links")
    discard(pairs)
    return out


def _rooted(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (v, root): the component of each representative (rep, sig) that has a link.

    First each bucket's members are held against its weightiest, which joins most copies of a text. Then only
    members of buckets with several components are left, and pairs between those components are found by ``_across``.
    """
    keys = written(reps.mapInArrow(_keys, "key long, rep long"), "near-keys")
    shared = keys.groupBy("key").agg(F.min("rep").alias("least"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n")).where("least <> last").select("key", "n")
    plain = written(keys.join(parted(shared, "key"), "key"), "near-plain")
    discard(keys)
    # The text that a family of copies comes from holds the values most of them hold, so its buckets are the largest.
    weights = plain.groupBy("rep").agg(F.sum("n").alias("weight"))
    met = written(plain.select("key", "rep").join(parted(weights, "rep"), "rep"), "near-weighed")
    # Signatures tie often, and the source's own cannot be told from a close copy's: four leaders, by four orders of ties.
    ties = [-F.col("rep"), F.col("rep"), F.xxhash64("rep", F.lit(1)), F.xxhash64("rep", F.lit(2))]
    best = [F.max(F.struct("weight", t.alias("t"), "rep")).alias(f"m{k}") for k, t in enumerate(ties)]
    leads = met.groupBy("key").agg(*best).select("key", F.col("m0.rep").alias("lead"), F.array(*[f"m{k}.rep" for k in range(len(ties))]).alias("leads"))
    weighed, met = met, written(met.select("key", "rep").join(parted(leads, "key"), "key"), "near-met")
    discard(plain, weighed)
    # The texts of all documents are gone through once; whatever follows reads those that share a bucket with another.
    members = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(members.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = written(texts, "near-texts")
    stars = met.select("rep", F.explode("leads").alias("l")).where("rep <> l").select(F.least("l", "rep").alias("a"), F.greatest("l", "rep").alias("b")).distinct()
    first = _confirmed(_close(stars, reps), texts)
    roots = written(components(first), "near-roots")
    placed = met.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("key", "rep", "lead", F.coalesce("root", "rep").alias("root"))
    placed = written(placed, "near-placed")
    split = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    open_ = written(placed.join(parted(split, "key"), "key", "left_semi"), "near-open")
    discard(met, placed)
    cross = _across(open_, reps, texts)
    # A leader's pairs were decided in the first round.
    second = _confirmed(_close(cross.join(first, ["a", "b"], "left_anti"), reps), texts)
    discard(open_, texts)
    if second.isEmpty():
        return roots
    # Links of the second round join whole components, so only their roots are gone through again.
    ends = second.join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("v").alias("b"), F.col("root").alias("rb")), "b", "left")
    upper = written(components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))), "near-roots")
    lower = roots.join(upper.select(F.col("v").alias("root"), F.col("root").alias("top")), "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    return written(lower.unionByName(upper.join(roots.select("v"), "v", "left_anti")), "near-roots")


def _ranked(tokens: DataFrame, key: list[str]) -> DataFrame:
    """Rows (rep, root, ``key``) with ``df``, the rows that hold the key, of keys that two components hold. Keys are counted before they are shuffled."""
    held = tokens.groupBy(*key).agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").drop("r0", "r1")
    return tokens.join(parted(held, *key), key)


def _alive(open_: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows (rep, root, token) of the members of ``open_`` that may be within the distance of a member of another component.

    Within the distance, 33 of 64 places agree, so each two share one of the 32 rarest (place, value) pairs
    of either: ``token`` goes through those of them that two components hold. What only a widespread passage has brought together shares none of these.
    """
    members = open_.select("rep", "root").distinct()
    places = members.join(reps, "rep").select("rep", "root", F.posexplode("sig").alias("k", "v"))
    tokens = written(places.select("rep", "root", (F.col("k") * (1 << BITS) + F.col("v")).alias("token")), "near-places")
    ranked = _ranked(tokens, ["token"])
    # Places that no other component holds come first in the order; a doc's other places are told by their number.
    order = Window.partitionBy("rep").orderBy(F.desc("df"), "token")
    kept = ranked.withColumn("from_end", F.row_number().over(order)).where(F.col("from_end") > PLACES - MAX_DISTANCE - 1)
    split = kept.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    out = written(kept.join(parted(split, "token"), "token", "left_semi").select("rep", "root", "token"), "near-alive")
    discard(tokens)
    return out


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (rep, root, family, text, text of the family's leader): sizes, shared shingles, and the shingles that the latter lacks."""
    last: tuple[str | None, np.ndarray] = (None, np.zeros(0, np.uint64))
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            n, inside, places, values = [], [], [0], []
            for k, own in enumerate(shingle_sets(part.column(3))):
                ref = part.column(4)[k].as_py()
                if ref != last[0]:
                    last = ref, next(shingle_sets(pa.array([ref], pa.string())))
                rest = np.setdiff1d(own, last[1], assume_unique=True)
                n.append(len(own))
                inside.append(len(own) - len(rest))
                values.append(rest.view(np.int64))
                places.append(places[-1] + len(rest))
            rest = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(inside, pa.int64()), rest], ["rep", "root", "family", "n", "inside", "rest"])


def _across(open_: DataFrame, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that hold all links between them, without listing the pairs of a bucket.

    Members of buckets with one leader form a family, and two that share a bucket share a family. With the leader's text R, two texts x and y share
    at most min(|x & R|, |y & R|) shingles inside R, and for a link they need 3/7 of |x| + |y|. So either both hold that
    many inside R (A), or they share a shingle outside R (B), and then one of the rarest of each, as many as its size allows.
    """
    alive = _alive(open_, reps)
    members = open_.select("rep", "root", F.col("lead").alias("family")).join(alive.select("rep").distinct(), "rep", "left_semi").distinct()
    members = written(members, "near-members")
    own = members.join(texts.select(F.col("doc_id").alias("rep"), "text"), "rep")
    both = own.join(texts.select(F.col("doc_id").alias("family"), F.col("text").alias("first")), "family")
    parts = both.select("rep", "root", "family", "text", "first").mapInArrow(_differences, "rep long, root long, family long, n long, inside long, rest array<long>")
    parts = written(parts, "near-raw-parts")
    # What many of a family hold beside R is counted as inside: the bound holds for any set of shingles in R's place.
    least = F.ceil(F.col("n") * 3 / 4)
    tokens = parts.select("rep", "root", "family", F.explode("rest").alias("token"))
    held = tokens.groupBy("family", "token").agg(F.count(F.lit(1)).alias("df"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    held = written(held.where("r0 <> r1"), "near-held")
    more = tokens.join(held.where(F.col("df") > COMMON).select("family", "token"), ["family", "token"]).groupBy("rep", "family").agg(F.count(F.lit(1)).alias("more"))
    raw, parts = parts, parts.join(more, ["rep", "family"], "left").withColumn("inside", F.col("inside") + F.coalesce("more", F.lit(0).cast("long"))).drop("more")
    parts = written(parts, "near-parts")
    discard(members, raw)
    # (A) Sizes go to classes of 5 percent; x asks for the classes of sizes that its shared shingles suffice for. They meet
    # under a rare place of both signatures, which every pair within the distance has, so excerpts of one text from different passages of it do not.
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05)))
    most = F.floor(7 * F.col("inside") / 3) - F.col("n")
    asks = parts.where(most >= least).select("rep", "root", "family", "n", "inside", F.explode(F.sequence(
        F.floor(F.log(least.cast("double")) / F.log(F.lit(1.05))), F.floor(F.log(most.cast("double")) / F.log(F.lit(1.05))))).alias("size_class"))
    sized = parts.where(most >= least).withColumn("size_class", size_class).select("rep", "root", "family", "n", "inside", "size_class")
    rare = alive.select("rep", "token")
    x, y = asks.join(rare, "rep").alias("x"), sized.join(rare, "rep").alias("y")
    fits = F.least("x.inside", "y.inside") * 7 >= (F.col("x.n") + F.col("y.n")) * 3
    apart = (F.col("x.family") == F.col("y.family")) & (F.col("x.root") != F.col("y.root"))
    inner = x.join(y, apart & (F.col("x.size_class") == F.col("y.size_class")) & (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")) & fits)
    # (B) Shingles outside R, rarest first: those that one component alone holds, then by how many hold them.
    outer = parts.select("rep", "root", "family", F.size("rest").alias("m"), (least - F.col("inside")).alias("need"), F.explode("rest").alias("token"))
    ranked = outer.join(held.where(F.col("df") <= COMMON).select("family", "token", "df"), ["family", "token"])
    from_end = F.row_number().over(Window.partitionBy("rep", "family").orderBy(F.desc("df"), "token"))
    kept = ranked.withColumn("from_end", from_end).where(F.col("from_end") >= F.greatest(F.lit(1), F.col("need"))).select("rep", "root", "family", "token")
    kept = written(kept, "near-rare")
    x, y = kept.alias("x"), kept.alias("y")
    outside = x.join(y, apart & (F.col("x.token") == F.col("y.token")) & (F.col("x.rep") < F.col("y.rep")))
    pair = [F.col("x.rep").alias("a"), F.col("y.rep").alias("b")]
    out = written(inner.select(*pair).unionByName(outside.select(*pair)).distinct(), "near-across")
    discard(parts, kept, held, alive)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, text): doc_id, n_shingles, component_id, kept.

    Shingles are five words, A-Z lower-cased; documents are linked from a similarity of 0.75.
    Rows without a word have no shingle and are alone. Rows that repeat a doc_id repeat in the result, and each
    stays. Null doc_ids are left out of links: they are alone with a null component and are kept.
    """
    base = written(signed(docs), "near-signed")
    work = base.where("doc_id IS NOT NULL AND n_shingles > 0")
    by_set = written(work.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "near-sets")
    reps = written(work.join(by_set.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), "sig"), "near-reps")
    roots = _rooted(reps, docs)
    classes = by_set.join(roots.withColumnRenamed("v", "rep"), "rep", "left").select("set_a", "set_b", "n_shingles", F.coalesce("root", "rep").alias("root"))
    classes = written(classes, "near-classes")
    out = base.drop("sig").join(classes, ["set_a", "set_b", "n_shingles"], "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), own))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents``. Null, empty and wordless texts are alone, repeated rows each have a row, null doc_ids are alone and kept, an empty table gives no row."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, with all its columns; rows without a doc_id, a text or words stay, as do repeated rows of one that stays. An empty table stays empty."""
    drop = near_duplicates(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
