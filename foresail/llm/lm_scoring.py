"""Cross-entropy difference of documents under matched target and background n-gram models.

Both models are interpolated bigram models of the same form over one vocabulary: every word of the
corpus. Every document is counted for the background, and every target document for the target.
Words and bigrams are known by 64-bit hashes; no count is dropped, folded or kept in a table of fixed size.

Texts are taken in chunks. A chunk's different words and bigrams go with their counts to the buckets of
their hashes, once each however common they are. A bucket adds them up over all chunks and answers
every chunk with the sums in the order in which it asked, and the chunk's texts are scored from the answers.
A chunk asks every bucket for words, if only with an empty list, and each answer has the bucket's share of the totals.

A document's score is the mean over its words of background loss less target loss, in
nats: the higher, the more it reads like the target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, written
from .textkit import mix, text_bytes, word_hashes

SHARE = 0.6  #: weight of the bigram's share against the unigram's
ROWS = 512
PART_BYTES = 1 << 21  #: text taken into a chunk at a time, a longer one alone: bounds what a chunk has beyond CHUNK
CHUNK = 1 << 20  #: words from which a chunk is closed
BUCKET_BYTES = 1 << 22  #: text for which there is a bucket
LEAST_BUCKETS = 128
DOCS, PAIRS, WORDS = 0, 1, 2  #: kinds of a chunk's rows
_START = np.uint64(0)  #: the context at a text's start
_NOTHING = np.zeros(0, np.int64)
_CONTEXT, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_CHUNKS = "chunk long, counted boolean, asks boolean, payload binary"
_ASKED = "chunk long, bucket int, asks boolean, payload binary"
_ANSWERS = "chunk long, bucket int, payload binary, kind int, words long, target long, background long"
_SCORES = "doc_id long, n_words long, target_loss double, background_loss double, score double"


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in the narrowest type that holds it and plane by plane of bytes, compressed."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
        out += [np.array([len(a), width], np.int64).tobytes(), a.astype(f"u{width}").view(np.uint8).reshape(-1, width).T.tobytes()]
    data = b"".join(out)
    return np.int64(len(data)).tobytes() + pa.Codec("zstd", 1).compress(data, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    data = pa.Codec("zstd").decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), asbytes=True)
    out, at = [], 0
    while at < len(data):
        n, width = (int(x) for x in np.frombuffer(data, np.int64, 2, at))
        planes = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(n))
        at += 16 + n * width
    return out


def _bigrams(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the id before it (0 at a text's start), and both as one number."""
    before = np.concatenate((np.zeros(1, np.int64), ids[:-1])) if len(ids) else ids
    before[(np.cumsum(counts) - counts)[counts > 0]] = 0
    return before, (before << 32) | ids


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])


def _cuts(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of rows of text into ROWS or PART_BYTES, whichever is less, and one row at least."""
    at, end = 0, len(offsets) - 1
    while at < end:
        to = int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1
        to = min(max(to, at + 1), at + ROWS, end)
        yield at, to
        at = to


def _chunked(counted: bool, asks: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of (doc_id, text, is_target): the chunk's different words, and its texts as places in them."""

    def closed(chunk: int, held: list[tuple]) -> pa.RecordBatch:
        docs, valid, target, counts, words = (np.concatenate(x) for x in zip(*held))
        vocab, ids = np.unique(np.concatenate(([_START], words)), return_inverse=True)
        return _batch([(chunk, counted, asks, _pack(docs.view(np.uint64), valid, target, counts, vocab, ids[1:]))], _CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for at, to in _cuts(offsets):
                part = batch.slice(at, to - at)
                words, counts = word_hashes(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                ids = part.column(0)
                docs = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                target = part.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
                held.append((docs, ids.is_valid().to_numpy(zero_copy_only=False), target, counts, words))
                size += len(words)
                if size >= CHUNK:
                    yield closed(chunk, held)
                    chunk, held, size = chunk + 1, [], 0
        if held:
            yield closed(chunk, held)

    return run


class _Chunk:
    """A chunk read again: its texts, and its words and bigrams in the order in which it asks for them."""

    def __init__(self, payload: bytes, buckets: int):
        self.docs, self.valid, self.target, counts, vocab, ids = _unpack(payload)
        self.docs, self.counts, self.ids = self.docs.astype(np.uint64).view(np.int64), counts.astype(np.int64), ids.astype(np.int64)
        self.vocab, self.buckets = vocab.astype(np.uint64), buckets
        self.before, both = _bigrams(self.ids, self.counts)
        self.pairs, self.place = np.unique(both, return_inverse=True)

    def keys(self, kind: int) -> np.ndarray:
        if kind == WORDS:
            return self.vocab
        return mix(self.vocab[self.pairs >> 32] * _CONTEXT + self.vocab[self.pairs & 0xFFFFFFFF] * _WORD)

    def dealt(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket that has keys, in rising order, and their places by rising key."""
        order = np.argsort(keys)
        found, at = np.unique((keys[order] >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32), return_index=True)
        yield from zip(found.tolist(), np.split(order, at[1:]))

    def sums(self, kind: int, counted: bool) -> list[np.ndarray]:
        """Counts in target texts and in all: of bigrams, or of words and then of contexts."""
        wanted = np.repeat(self.target.astype(bool), self.counts)
        size = len(self.vocab if kind == WORDS else self.pairs)
        out = []
        for what in (self.ids, self.before) if kind == WORDS else (self.place,):
            out += [np.bincount(what[wanted], minlength=size), np.bincount(what, minlength=size)]
        return out if counted else [np.zeros(size, np.int64)] * len(out)


def _asked(kind: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words or bigrams of chunks with their counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, counted, asks, payload in zip(*batch.columns):
                c = _Chunk(payload.as_py(), buckets)
                keys, sums = c.keys(kind), c.sums(kind, counted.as_py())
                rows, dealt = [], dict(c.dealt(keys))
                for bucket in range(buckets) if kind == WORDS and asks.as_py() else dealt:
                    at = dealt.get(bucket, _NOTHING)
                    rows.append((chunk.as_py(), bucket, asks.as_py(), _pack(np.diff(keys[at], prepend=np.uint64(0)), *(x[at] for x in sums))))
                    if len(rows) == 64:
                        yield _batch(rows, _ASKED)
                        rows = []
                if rows:
                    yield _batch(rows, _ASKED)

    return run


def _answered(kind: int) -> Callable[[pa.Table], pa.Table]:
    """Sums over all chunks of what a bucket was sent, for each chunk that asks, and for words what the bucket adds to the totals."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        sent = [_unpack(x) for x in rows.column("payload").to_pylist()]
        keys, place = np.unique(np.concatenate([np.cumsum(s[0], dtype=np.uint64) for s in sent]), return_inverse=True)
        # Sums as doubles are exact up to 2^53.
        sums = [np.bincount(place, np.concatenate([s[k] for s in sent]), len(keys)).astype(np.int64) for k in range(1, len(sent[0]))]
        totals = (int(np.count_nonzero(sums[1])), int(sums[0].sum()), int(sums[1].sum())) if kind == WORDS else (None, None, None)
        out, at = [], 0
        for chunk, asks, s in zip(rows.column("chunk").to_pylist(), rows.column("asks").to_pylist(), sent):
            if asks:
                out.append((chunk, bucket, _pack(*(x[place[at : at + len(s[0])]] for x in sums)), kind, *totals))
            at += len(s[0])
        return pa.Table.from_batches([_batch(out, _ANSWERS)])

    return run


def _scored(buckets: int, least: int) -> Callable[[pa.Table], pa.Table]:
    """Scores of a chunk's texts from the chunk and the answers of all buckets."""

    def run(rows: pa.Table) -> pa.Table:
        kinds, payloads = rows.column("kind").to_pylist(), rows.column("payload")
        c = _Chunk(payloads[kinds.index(DOCS)].as_py(), buckets)
        places = {kind: dict(c.dealt(c.keys(kind))) for kind in (PAIRS, WORDS)}
        sums = {PAIRS: np.zeros((2, len(c.pairs)), np.int64), WORDS: np.zeros((4, len(c.vocab)), np.int64)}
        for kind, bucket, payload in zip(kinds, rows.column("bucket").to_pylist(), payloads):
            if kind != DOCS:
                sums[kind][:, places[kind].pop(bucket, _NOTHING)] = _unpack(payload.as_py())
        if places[PAIRS] or places[WORDS] or kinds.count(WORDS) != buckets:
            raise RuntimeError("a chunk of texts has not all its counts")
        known, *totals = (sum(x or 0 for x in rows.column(name).to_pylist()) for name in ("words", "target", "background"))
        size = max(least, known + 1)
        before, word = c.pairs >> 32, c.pairs & 0xFFFFFFFF
        row = np.repeat(np.arange(len(c.counts)), c.counts)
        losses = []
        for k in range(2):
            context = sums[WORDS][2 + k][before]
            # Add-one smoothing over the shared vocabulary gives every word some probability in either model, and a context that
            # the model has not seen leaves all of it to them: the probabilities after any context add up to 1.
            seen = np.where(context > 0, SHARE, 0.0)
            p = seen * sums[PAIRS][k] / np.maximum(context, 1) + (1 - seen) * (sums[WORDS][k][word] + 1) / (totals[k] + size)
            losses.append(np.bincount(row, -np.log(p)[c.place], len(c.counts)) / np.maximum(c.counts, 1))
        target, background = losses
        ids = pa.array(c.docs, mask=c.valid == 0)
        return pa.table([ids, pa.array(c.counts), pa.array(target), pa.array(background), pa.array(background - target)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


class Models:
    """What both models are counted from, as a table of chunks in the shared folder; ``size`` is as in ``train``."""

    def __init__(self, parts: DataFrame, buckets: int, size: int | None):
        self.parts, self.buckets, self.size = parts, buckets, size

    def losses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of each row, and the summed losses (target, background) of each row."""
        docs = self.parts.sparkSession.createDataFrame(list(enumerate(column.to_pylist())), "doc_id long, text string")
        rows = sorted(score(docs, self).collect())
        n = np.array([r.n_words for r in rows], np.int64)
        return n, np.array([[r.target_loss * r.n_words for r in rows], [r.background_loss * r.n_words for r in rows]])


def _buckets(docs: DataFrame) -> int:
    """As many as the texts need, so that a bucket's size does not grow with them."""
    return max(LEAST_BUCKETS, (docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0) // BUCKET_BYTES)


def _parts(docs: DataFrame, counted: bool, asks: bool) -> DataFrame:
    """Chunks of (doc_id, text, is_target), written: what is asked and what is scored must be the same chunks."""
    return written(docs.select("doc_id", "text", "is_target").mapInArrow(_chunked(counted, asks), _CHUNKS), "lm-chunks")


def train(docs: DataFrame, corpus: DataFrame | None = None, size: int | None = None, asks: bool = False) -> Models:
    """Models of (text, is_target boolean): target rows for one, all rows for the other. ``corpus`` has the same texts, perhaps before a join.

    Null text has no words. Without target rows the target model is the uniform one.
    Add-one smoothing takes all counted words and one for the others, or ``size`` words if that is more.
    With ``asks`` the rows, which have a doc_id then, can be scored without another pass by ``score_trained``.
    """
    ship(docs.sparkSession)
    buckets = _buckets(docs if corpus is None else corpus)
    if "doc_id" not in docs.columns:
        docs = docs.withColumn("doc_id", F.lit(None).cast("long"))
    return Models(_parts(docs, True, asks), buckets, size)


def _joined(parts: DataFrame, asked: DataFrame, models: Models) -> DataFrame:
    """Scores of the chunks of ``asked`` under the counts in ``parts``, which holds ``asked`` too."""
    answers = {kind: parts.mapInArrow(_asked(kind, models.buckets), _ASKED).groupBy("bucket").applyInArrow(_answered(kind), _ANSWERS) for kind in (WORDS, PAIRS)}
    columns = ["chunk", "bucket", "payload", "kind", "words", "target", "background"]
    nothing = [F.lit(None).cast("long").alias(c) for c in columns[4:]]
    every = asked.select("chunk", F.lit(None).cast("int").alias("bucket"), "payload", F.lit(DOCS).alias("kind"), *nothing)
    # Only the chunks are written: every file that a task writes to a local folder is a few helper processes started by its executor.
    every = every.unionByName(answers[WORDS].select(*columns)).unionByName(answers[PAIRS].select(*columns))
    return every.groupBy("chunk").applyInArrow(_scored(models.buckets, models.size or 0), _SCORES)


def score_trained(models: Models) -> DataFrame:
    """As ``score``, of the rows that ``models`` were trained on with ``asks``."""
    return _joined(models.parts, models.parts, models)


def score(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (nats a word) and score of (doc_id, text); without words all are 0."""
    ship(docs.sparkSession)
    asked = _parts(docs.select("doc_id", "text", F.lit(False).alias("is_target")), False, True)
    return _joined(models.parts.withColumn("asks", F.lit(False)).unionByName(asked), asked, models)


def with_target(docs: DataFrame, labels: DataFrame, wanted: Column) -> DataFrame:
    """(doc_id, text, is_target): target are the documents with a label row that meets ``wanted``; a doc_id counts once however often it is labelled."""
    chosen = labels.where(wanted).select("doc_id").distinct().withColumn("chosen", F.lit(True))
    # Both sides grow with the corpus, so neither is ever broadcast.
    return docs.select("doc_id", "text").join(chosen.hint("merge"), "doc_id", "left").select("doc_id", "text", F.coalesce("chosen", F.lit(False)).alias("is_target"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; the target is what ``labels`` marks as of high quality. Null, empty and wordless texts score 0, repeated rows each have a row, an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    rows = with_target(docs, table(spark, sf_dir, "labels"), F.col("quality") == 1)
    return score_trained(train(rows, docs, asks=True))
