"""A content-addressed store of token ids.

Each document's id stream is cut where a rolling hash of its last ids says so, so equal
passages give equal chunks. A chunk is stored once under its digest. A document is a
recipe: the digests of its chunks in order. Manifests hold Merkle roots of segments of
recipes, so that a reader can prove that what it put together is what was written.

Layout of a store: ``chunks`` (digest, n, ids) sorted by digest; ``recipes`` (doc_id,
start, n_tokens, chunks) in ascending doc_id; ``manifest`` (segment, rows, first_start,
root), one row a segment of recipes. All are Parquet in the store's folder.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, local_options, scratch_path, ship, table, written
from .textkit import text_bytes
from .tokenizing import Encoder, gathered, vocabulary_path

WINDOW = 12  #: ids under the rolling hash
MASK_BITS = 8  #: a cut every 256 ids on average
LEAST, MOST = 64, 2048
_RNG = np.random.Generator(np.random.PCG64(49))
_GEAR = _RNG.integers(0, 1 << 63, 1 << 16, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15 | 1
_SHIFTS = [np.uint64(pow(_STEP, k, 1 << 64)) for k in range(WINDOW + 1)]
_POWERS = [np.uint64(pow(_STEP, 1 << k, 1 << 64)) for k in range(WINDOW.bit_length())]
BLOCK = 1 << 15  #: ids hashed at a time


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the hash of the last WINDOW ids asks for a cut: the sum of their gears, each times _STEP to its distance."""
    found = []
    for at in range(0, len(ids), BLOCK):
        first = max(0, at - WINDOW + 1)
        g = _GEAR[ids[first : at + BLOCK] & 0xFFFF]
        # Sums over 1, 2, 4, ... ids, each from two of half as many; those that WINDOW is made of are added up.
        rolling, done = np.zeros(len(g), dtype=np.uint64), 0
        for k, power in enumerate(_POWERS):
            span = 1 << k
            if WINDOW & span:
                rolling[done:] += g[: max(0, len(g) - done)] * _SHIFTS[done]
                done += span
            g[span:] += g[:-span] * power
        found.append(np.flatnonzero((rolling[at - first :] >> np.uint64(64 - MASK_BITS)) == 0) + (at + 1))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(found: list[int], start: int, stop: int) -> list[int]:
    """Ends, from ``start`` on, of the chunks of ids start to stop: set by content alone, LEAST to MOST ids each but for the last."""
    out, at = [], start
    for m in found:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST and m < stop:
            at = m
            out.append(at)
    while stop - at > MOST:
        at += MOST
        out.append(at)
    if at < stop:
        out.append(stop)
    return [x - start for x in out]


def all_cuts(streams: list[np.ndarray]) -> list[list[int]]:
    """Ends of the chunks of each id stream.

    Hashes are taken over all streams in a row. Near a stream's start they see ids of the one before, but marks there
    are not heeded: LEAST is more than WINDOW.
    """
    ends = np.cumsum([len(x) for x in streams])
    found = marks(np.concatenate(streams)) if streams else np.zeros(0, np.int64)
    stops = np.searchsorted(found, ends, "right").tolist()
    found, out, at, first = found.tolist(), [], 0, 0
    for end, stop in zip(ends.tolist(), stops):
        out.append(chunk_ends(found[first:stop], at, end))
        at, first = end, stop
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream."""
    return all_cuts([ids])[0]


def digest(data: bytes | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


#: Digests whose ids a task has passed on lately: a chunk that many documents share is sent on once a task, not once a document.
SEEN = 1 << 17
_STAGED = "doc_id long, n_tokens long, chunks array<struct<digest:binary,n:int>>, fresh array<struct<digest:binary,n:int,ids:binary>>"


def _staging(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder.of(path), {}
        for batch in gathered(batches, 1):
            every = encoder.ended(batch.column(1))
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                sizes, places, names, counts, own, new, new_counts, data = [], [0], [], [], [0], [], [], []
                streams = list(islice(every, len(part)))
                for ids, ends in zip(streams, all_cuts(streams)):
                    last, raw, width = 0, ids.tobytes(), ids.itemsize
                    for end in ends:
                        piece = raw[last * width : end * width]
                        d = digest(piece)
                        names.append(d)
                        counts.append(end - last)
                        if d not in seen:
                            seen[d] = None
                            new.append(d)
                            new_counts.append(end - last)
                            data.append(piece)
                        last = end
                    if len(seen) > SEEN:
                        seen = {}
                    sizes.append(len(ids))
                    places.append(len(names))
                    own.append(len(new))
                recipes = pa.StructArray.from_arrays([pa.array(names, pa.binary()), pa.array(counts, pa.int32())], ["digest", "n"])
                fresh = pa.StructArray.from_arrays([pa.array(new, pa.binary()), pa.array(new_counts, pa.int32()), pa.array(data, pa.binary())], ["digest", "n", "ids"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), recipes), pa.ListArray.from_arrays(pa.array(own, pa.int32()), fresh)],
                    ["doc_id", "n_tokens", "chunks", "fresh"],
                )

    return run


def numbered(rows: DataFrame, size: str, *order: str) -> DataFrame:
    """``rows`` in ascending order, written, with ``start``: the sum of ``size`` over all rows before.

    Ranges of the order go to partitions; each adds up its own rows, and only one total a partition
    (a column ``segment``) meets the others.
    """
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("segment", F.spark_partition_id())
    placed = written(parts, "ranges")
    totals = placed.groupBy("segment").agg(F.sum(size).alias("s"))
    before = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    totals = written(totals.select("segment", F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")).alias("base")), "range-totals")
    within = Window.partitionBy("segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(totals, "segment").withColumn("start", F.col("base") + F.coalesce(F.sum(size).over(within), F.lit(0).cast("long"))).drop("base")
    out._sources = (placed, totals)  # type: ignore[attr-defined]
    return out


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree of digests; an odd one goes up as it is. No leaf: the digest of nothing."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        pairs = [digest(b"\x01" + leaves[i] + leaves[i + 1]) for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


SEGMENT_ROWS = 1 << 14  #: recipes under one Merkle root


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One root for each run of a segment of recipes that a task reads; a segment's recipes come in order within one file.

    A leaf holds all of a recipe: the document's id, its place, its size and the digests of its chunks.
    """
    found: dict[tuple, list[bytes]] = {}
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(2))))
        heads = zip(*(batch.column(k).to_pylist() for k in range(2, 5)))
        parts = batch.column(5)
        names = parts.flatten().to_pylist()
        ends = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
        for key, head, a, b in zip(keys, heads, ends, ends[1:]):
            found.setdefault(key, []).append(digest(b"\x00" + str(head).encode() + b"".join(names[a:b])))
    names = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in names], pa.int32()), pa.array([k[1] for k in names], pa.int64()), pa.array([len(found[k]) for k in names], pa.int64()), pa.array([_merkle(found[k]) for k in names], pa.binary())],
        ["segment", "block", "n_docs", "root"],
    )


def _manifest(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("segment", "block", "doc_id", "start", "n_tokens", F.col("chunks.digest").alias("names"))
    return rows.repartition("segment", "block").sortWithinPartitions("segment", "block", "start", "doc_id").mapInArrow(_roots, "segment int, block long, n_docs long, root binary")


def write_store(docs: DataFrame, location: str, path: str | None = None) -> None:
    """Encode (doc_id, text) and write a store at ``location``, a new folder that all executors share.

    Null and empty texts are one end id. Rows that repeat a doc_id are each stored, side by side. An empty table makes an empty store.
    """
    spark = docs.sparkSession
    ship(spark)
    options = local_options(spark, location)
    staged = written(docs.select("doc_id", "text").mapInArrow(_staging(path or vocabulary_path()), _STAGED), "tokens")
    # Tasks send a chunk on once, so few meet an equal one before the exchange: they are sorted after it only.
    fresh = staged.select(F.explode("fresh").alias("c")).select("c.*").repartition("digest").sortWithinPartitions("digest")
    chunks = fresh.groupBy("digest").agg(F.max("n").alias("n"), F.max("ids").alias("ids"))
    chunks.sortWithinPartitions("digest").write.options(**options).option("compression", "zstd").parquet(f"{location}/chunks")
    recipes = numbered(staged.select("doc_id", "n_tokens", "chunks"), "n_tokens", "doc_id", "n_tokens")
    discard(staged)
    ranges = recipes._sources
    in_order = Window.partitionBy("segment").orderBy("start", "doc_id")
    recipes = recipes.withColumn("block", F.floor((F.row_number().over(in_order) - 1) / F.lit(SEGMENT_ROWS)))
    recipes.write.options(**options).parquet(f"{location}/recipes")
    discard(*ranges)
    _manifest(spark.read.schema(recipes.schema).parquet(f"{location}/recipes")).write.options(**options).parquet(f"{location}/manifest")


_CHECKED = "digest binary, stored_n int, crc long, sound boolean"


def _checked(width: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(width).itemsize
        for batch in batches:
            names, crcs, sound = batch.column(0).to_numpy(zero_copy_only=False).tolist(), [], []
            data, offsets = text_bytes(batch.column(1))
            ends = offsets // size
            if (ends * size != offsets).any():
                raise ValueError("a chunk that ends within an id")
            # Ids are widened for all chunks at once, and cut by views.
            ids, data = memoryview(data.view(width).astype("<u4")), memoryview(data)
            for d, a, b in zip(names, ends.tolist(), ends[1:].tolist()):
                crcs.append(zlib.crc32(ids[a:b]))
                sound.append(digest(data[a * size : b * size]) == d)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int32()), pa.array(crcs, pa.int64()), pa.array(sound)], ["digest", "stored_n", "crc", "sound"])

    return run


def _times(matrix: Sequence[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


def _zero_operators() -> list[list[int]]:
    """For k = 0, 1, ...: what 2**k zero bytes after a message do to its crc32, as a matrix over bits."""
    one = [0xEDB88320] + [1 << k for k in range(31)]  # one zero bit
    for _ in range(3):
        one = [_times(one, c) for c in one]
    out = [one]
    for _ in range(40):
        out.append([_times(out[-1], c) for c in out[-1]])
    return out


_ZEROS: list[list[int]] = []


@lru_cache(maxsize=1 << 14)
def _zeros(length: int) -> tuple[int, ...]:
    """What ``length`` zero bytes do, as one matrix."""
    if not _ZEROS:
        _ZEROS.extend(_zero_operators())
    out, k = [1 << b for b in range(32)], 0
    while length:
        if length & 1:
            out = [_times(_ZEROS[k], c) for c in out]
        length >>= 1
        k += 1
    return tuple(out)


def crc_join(first: int, second: int, length: int) -> int:
    """The crc32 of two messages in a row from their own, ``length`` being the second's bytes."""
    return _times(_zeros(length), first) ^ second if first else second


@lru_cache(maxsize=None)
def _tables(k: int) -> np.ndarray:
    """What 2**k zero bytes do to a crc32, for each value of each of its four bytes."""
    if not _ZEROS:
        _ZEROS.extend(_zero_operators())
    out, values = np.zeros((4, 256), dtype=np.uint32), np.arange(256)
    for bit, effect in enumerate(_ZEROS[k]):
        out[bit // 8] ^= np.where(values >> bit % 8 & 1, np.uint32(effect), np.uint32(0))
    return out


def crcs_joined(crcs: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each message from those of its parts: ``sizes`` are the parts' bytes, and ``ends`` says where each message's parts start and the last's end.

    A message's crc32 is that of all parts, each followed by as many zero bytes as come after it, xored together.
    """
    x, done = crcs.astype(np.uint32), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    after = np.repeat(done[ends[1:]], np.diff(ends)) - done[1:]
    for k in range(int(after.max(initial=0)).bit_length()):
        pick = np.flatnonzero(after >> k & 1)
        v, t = x[pick], _tables(k)
        x[pick] = t[0][v & 255] ^ t[1][v >> 8 & 255] ^ t[2][v >> 16 & 255] ^ t[3][v >> 24]
    out, full = np.zeros(len(ends) - 1, dtype=np.uint32), np.diff(ends) > 0
    if full.any():
        out[full] = np.bitwise_xor.reduceat(x, ends[:-1][full])
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column(1)
        flat = parts.flatten()
        crcs, counts, held = (flat.field(k).fill_null(none).to_numpy(zero_copy_only=False) for k, none in ((1, 0), (2, 0), (3, False)))
        ends = (parts.offsets.to_numpy() - parts.offsets[0].as_py()).astype(np.int64)
        # A chunk that is not there, or is not what its digest says, leaves its document without a crc32.
        bad = np.diff(np.concatenate(([0], np.cumsum(~held)))[ends]) > 0
        sizes = np.diff(np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[ends])
        out = crcs_joined(crcs, counts.astype(np.int64) * 4, ends).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64(), mask=bad), pa.array(out, pa.int64(), mask=bad), pa.array(~bad)], ["start", "read_n", "ids_crc32", "sound"])


def _width(path: str | None) -> str:
    return Encoder.of(path or vocabulary_path()).type.str


def _segments(spark: SparkSession, location: str) -> DataFrame:
    """segment, block, n_docs (null: no recipe is left), kept_docs (null: the manifest has none) and fine of every segment: its Merkle root taken again from the recipes is the manifest's."""
    now = _manifest(spark.read.parquet(f"{location}/recipes"))
    kept = spark.read.parquet(f"{location}/manifest").select("segment", "block", F.col("n_docs").alias("kept_docs"), F.col("root").alias("kept"))
    return now.join(kept, ["segment", "block"], "full").select("segment", "block", "n_docs", "kept_docs", F.col("root").eqNullSafe(F.col("kept")).alias("fine"))


def read_digests(spark: SparkSession, location: str, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, sound of every stored document, from the store's files.

    Each chunk's ids are read once and checked against their digest; a document's crc32 is joined from those of its
    chunks in the recipe's order, so ids need not be moved to their documents. ``sound`` says that all digests held,
    that as many ids were read as the recipe names, and that the recipe's segment has the Merkle root of the manifest.
    Segments of the manifest of which no recipe is left, for whose documents no row could tell, are an error.
    """
    ship(spark)
    segments = written(_segments(spark, location), "segment-roots")
    lost = segments.where("n_docs IS NULL").agg(F.count(F.lit(1)).alias("n"), F.sum("kept_docs").alias("docs")).first()
    if lost["n"]:
        raise RuntimeError(f"{location}: {lost['n']} segments with {lost['docs']} recipes are lost")
    chunks = spark.read.parquet(f"{location}/chunks").select("digest", "ids").mapInArrow(_checked(_width(path)), _CHECKED)
    recipes = spark.read.parquet(f"{location}/recipes")
    parts = recipes.select("start", F.posexplode("chunks").alias("k", "c")).select("start", "k", "c.digest")
    parts = parts.join(chunks, "digest", "left")
    item = F.struct("k", "crc", "stored_n", "sound")
    whole = parts.groupBy("start").agg(F.array_sort(F.collect_list(item)).alias("parts"))
    whole = whole.mapInArrow(_joined, "start long, read_n long, ids_crc32 long, sound boolean").withColumnRenamed("sound", "held")
    out = recipes.select("doc_id", "start", "n_tokens", "segment", "block").join(whole, "start", "left").join(segments.select("segment", "block", "fine"), ["segment", "block"])
    sound = F.coalesce(F.col("held") & F.col("fine") & (F.col("read_n") == F.col("n_tokens")), F.lit(False))
    return out.select("doc_id", "start", F.col("read_n").alias("n_tokens"), "ids_crc32", sound.alias("sound"))


def verify(spark: SparkSession, location: str) -> DataFrame:
    """Segments whose Merkle root, taken again from the recipes, differs from the manifest's: none in a sound store."""
    ship(spark)
    return _segments(spark, location).where("NOT fine").select("segment", "block")


def read_documents(spark: SparkSession, location: str, wanted: Column | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, ids (array<long>) of the stored documents for which ``wanted`` holds (a condition on recipes)."""
    recipes = spark.read.parquet(f"{location}/recipes")
    if wanted is not None:
        recipes = recipes.where(wanted)
    width = _width(path)
    parts = recipes.select("doc_id", "start", F.posexplode("chunks").alias("k", "c")).select("doc_id", "start", "k", "c.digest")
    parts = parts.join(spark.read.parquet(f"{location}/chunks").select("digest", "ids"), "digest")
    whole = parts.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in p), width).astype(np.int64) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    ship(spark)
    return whole.mapInArrow(run, "doc_id long, start long, ids array<long>")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written to a store and read back. Null and empty texts are one end id, repeated rows stand side by side, an empty table gives no row.

    ``sound`` is false for a document whose chunks or recipe are not what was written.
    """
    location = scratch_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), location)
    return read_digests(spark, location)
