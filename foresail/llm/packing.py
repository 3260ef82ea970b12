"""Packing documents into windows of 4096 tokens by non-negative least squares.

Whole windows inside a document are sequences of their own. For the tails, pairs and
triples of lengths that fill a window exactly are enumerated, repeat counts are solved
against the histogram of lengths by non-negative least squares and rounded to what
there is. The tails left over are packed greedily, best fit from the longest on. What no
window takes follows as one stream, cut where a window ends: only its last window is not full.

The plan knows lengths, not documents: a tail's place follows from its length and its
rank among the tails of that length, so documents are placed by arithmetic, without
sorting or gathering them, and a length that a third of all documents share is no burden.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, ship, table, written
from .tokenizing import Encoder, gathered, vocabulary_path

WINDOW = 4096
#: Column generation: rounds at most, triples that a shortest length brings in a round, and steps of least squares in a round and at the end.
ROUNDS, PER_LENGTH, STEPS, LAST_STEPS = 10, 4, 60, 250
#: A greedy window may stay short of full by this share.
SLACK = 1 / 256


def pairs_of(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All (x, y, 0) out of ``lengths`` that add up to the window, x the shorter."""
    have = np.zeros(window + 1, dtype=bool)
    have[lengths] = True
    x = lengths[lengths * 2 <= window]
    x = x[have[window - x]]
    return np.stack([x, window - x, np.zeros_like(x)], axis=1).astype(np.int64)


def dearest_triples(price: np.ndarray, most: int = PER_LENGTH, least: float = 0.5) -> np.ndarray:
    """Of all x <= y <= z that add up to the window, for each x the ``most`` with the highest price[x] + price[y] + price[z] over ``least``.

    Every triple is priced; -inf marks lengths that there are none of. ``price`` has a place for each length from 0 to the window.
    """
    window, out = len(price) - 1, []
    for x in np.flatnonzero(price[: window // 3 + 1] > -np.inf).tolist():
        if not x:
            continue
        y = np.arange(x, (window - x) // 2 + 1)
        total = price[x] + price[y] + price[window - x - y]
        best = np.argpartition(-total, most)[:most] if len(total) > most else np.arange(len(total))
        best = best[total[best] > least]
        out.append(np.stack([np.full(len(best), x), y[best], window - x - y[best]], axis=1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def nonnegative_least_squares(combos: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, steps: int = LAST_STEPS) -> np.ndarray:
    """Repeats x >= 0 of the combinations that bring sum((use(x) - counts)**2) to its least: accelerated projected gradient."""
    m, n = len(combos), len(counts)
    if not m:
        return np.zeros(0)
    flat = combos.reshape(-1)

    def use(x: np.ndarray) -> np.ndarray:
        out = np.bincount(flat, np.repeat(x, 3), minlength=n)
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return r[combos].sum(axis=1)

    v = np.ones(m)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(use(v))
        size = np.linalg.norm(v)
        v /= size
    x = y = np.zeros(m) if start is None else start
    t = 1.0
    for _ in range(steps):
        nxt = np.maximum(0, y - back(use(y) - counts) / (1.05 * size))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t2 * (nxt - x)
        x, t = nxt, t2
    return x


def combinations(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two or three lengths (0: no third) that fill the window, and their repeats by least squares against ``counts`` (by length, up to the window).

    All pairs take part. Triples come in by column generation: after each solution all of them are priced by the histogram's
    residual, and the dearest of each shortest length join, until none would lower the squares or ROUNDS are over.
    The way is the same for any number of lengths and documents, and no triple is out of reach.
    """
    window, counts = len(counts) - 1, counts.astype(float)
    lengths = np.flatnonzero(counts[:window])
    combos = pairs_of(lengths[lengths > 0], window)
    x = nonnegative_least_squares(combos, counts, steps=STEPS)
    for _ in range(ROUNDS):
        used = np.bincount(combos.reshape(-1), np.repeat(x, 3), minlength=window + 1) if len(combos) else np.zeros(window + 1)
        price = np.where(counts > 0, counts - used, -np.inf)
        price[[0, window]] = -np.inf
        fresh = dearest_triples(price)
        if len(combos):
            code = combos[:, 0] * (window + 1) + combos[:, 1]
            fresh = fresh[~np.isin(fresh[:, 0] * (window + 1) + fresh[:, 1], code[combos[:, 2] > 0])]
        if not len(fresh):
            break
        combos, x = np.concatenate([combos, fresh]), np.concatenate([x, np.zeros(len(fresh))])
        x = nonnegative_least_squares(combos, counts, x, STEPS)
    return combos, nonnegative_least_squares(combos, counts, x)


def _longest(free: np.ndarray, room: int, took: Counter) -> int:
    """Fill ``took`` with the longest that fits, over and over; the room that stays."""
    while room:
        fits = np.flatnonzero(free[: room + 1])
        if not len(fits):
            break
        x = int(fits[-1])
        k = min(room // x, int(free[x]))
        took[x] += k
        free[x] -= k
        room -= k * x
    return room


def _best_pair(free: np.ndarray, room: int, took: Counter) -> int:
    """Fill ``took`` with the one or two lengths that fill most of ``room``; the room that stays."""
    y = np.flatnonzero(free[: room + 1])
    if not len(y):
        return room
    at = np.searchsorted(y, room - y, "right") - 1
    at = np.where((at >= 0) & (y[at] == y) & (free[y] < 2), at - 1, at)  # a length twice needs two of them
    z = np.where(at >= 0, y[at], 0)
    k = int(np.argmax(y + z))
    for x in (int(y[k]), int(z[k])):
        if x:
            took[x] += 1
            free[x] -= 1
    return room - int(y[k] + z[k])


def greedy_windows(left: np.ndarray, slack: int) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Best fit from the longest on: ([(length, how often)], windows filled that way), of what ``left`` (by length) holds, which shrinks.

    A window takes the longest that fits until none does, or the pair that fits best, at once or after the longest. Of these the fullest is made, unless it
    stays short by more than ``slack``: then its longest length is left over. Whatever a filling repeats is done at once, so that the
    work grows with the lengths and not with the documents.
    """
    window = len(left) - 1
    top = window
    while len(have := np.flatnonzero(left[:top])):
        first = int(have[-1])
        best: tuple[int, Counter] | None = None
        for steps in ((_longest,), (_best_pair,), (_one, _best_pair)):
            free, took = left[:window].copy(), Counter({first: 1})
            free[first] -= 1
            room = window - first
            for step in steps:
                room = step(free, room, took)
            if best is None or room < best[0]:
                best = room, took
            if room == 0:
                break
        room, took = best
        if room > slack:
            top = first
            continue
        times = min(int(left[x]) // k for x, k in took.items())
        yield list(took.items()), times
        for x, k in took.items():
            left[x] -= k * times


def _one(free: np.ndarray, room: int, took: Counter) -> int:
    """The longest that fits, once."""
    fits = np.flatnonzero(free[: room + 1])
    if not len(fits):
        return room
    x = int(fits[-1])
    took[x] += 1
    free[x] -= 1
    return room - x


@dataclass
class Plan:
    """Where the tail of rank r among those of its length goes.

    For each length, runs of ranks (``edges``) have a first sequence and an offset; ranks from ``covered`` on
    follow each other in a stream of tokens from ``stream`` on that is cut into windows from sequence ``stream_base`` on.
    Whole windows come first: their sequence is their rank.
    """

    edges: dict[int, np.ndarray]
    bases: dict[int, np.ndarray]
    offsets: dict[int, np.ndarray]
    covered: dict[int, int]
    stream: dict[int, int]
    stream_base: int
    window: int
    tokens: tuple[int, int, int] = (0, 0, 0)  #: of tails, by least squares, greedily and in the stream


def make_plan(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """A plan from {length: documents}; lengths are 1 to the window, the window itself standing for whole windows."""
    left = np.zeros(window + 1, dtype=np.int64)
    for k, n in histogram.items():
        left[k] = n
    sequences = int(left[window])
    left[window] = 0
    combos, wanted = combinations(left)
    placed: dict[int, list[tuple[int, int, int]]] = {}
    used = np.zeros(window + 1, dtype=np.int64)

    def put(combo: list[int], n: int) -> None:
        nonlocal sequences
        at, ahead = 0, Counter()
        for x in combo:
            placed.setdefault(x, []).append((int(used[x]) + ahead[x], sequences, at))
            ahead[x] += n
            at += x
        for x, k in ahead.items():
            used[x] += k
        sequences += n

    order = np.argsort(-wanted, kind="stable")
    for rounding in (np.floor(wanted + 0.5), np.ceil(wanted)):
        for k in order.tolist():
            want = int(rounding[k])
            if want <= 0:
                break
            combo = [x for x in combos[k].tolist() if x]
            n = min(want, *(int(left[x]) // combo.count(x) for x in combo))
            if n:
                for x in combo:
                    left[x] -= n
                put(combo, n)
    by_plan = int(used @ np.arange(window + 1))
    for took, n in greedy_windows(left, int(window * SLACK)):
        put([x for x, k in took for _ in range(k)], n)
    by_greed = int(used @ np.arange(window + 1)) - by_plan
    stream, position = {}, 0
    for x in np.flatnonzero(left)[::-1].tolist():
        stream[x] = position
        position += x * int(left[x])
    return Plan(
        {x: np.array([p[0] for p in v]) for x, v in placed.items()}, {x: np.array([p[1] for p in v]) for x, v in placed.items()},
        {x: np.array([p[2] for p in v]) for x, v in placed.items()}, {x: int(used[x]) for x in range(1, window) if used[x]}, stream, sequences, window, (by_plan, by_greed, position),
    )


def place(plan: Plan, length: int, rank: int) -> list[tuple[int, int, int]]:
    """(piece's length, sequence, offset) of the tail of that rank, in order."""
    covered = plan.covered.get(length, 0)
    if rank < covered:
        k = int(np.searchsorted(plan.edges[length], rank, "right")) - 1
        return [(length, int(plan.bases[length][k]) + rank - int(plan.edges[length][k]), int(plan.offsets[length][k]))]
    at = plan.stream[length] + (rank - covered) * length
    sequence, offset = divmod(at, plan.window)
    first = min(length, plan.window - offset)
    out = [(first, plan.stream_base + sequence, offset)]
    if first < length:
        out.append((length - first, plan.stream_base + sequence + 1, 0))
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


_MEASURED = "doc_id long, n long, part int, tail int, rank_tail long, rank_full long, full_crcs array<long>, tail_crc long"


def _measuring(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path), TaskContext.get().partitionId()
        tails, full = np.zeros(window, dtype=np.int64), 0
        for batch in gathered(batches, 1):
            every = encoder.ended(batch.column(1))
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000)
                cols: list[list] = [[] for _ in range(7)]
                for ids in islice(every, len(rows)):
                    whole, tail = divmod(len(ids), window)
                    values = (len(ids), part, tail, int(tails[tail]), full, [_crc(ids[k * window : (k + 1) * window]) for k in range(whole)], _crc(ids[whole * window :]))
                    for c, v in zip(cols, values):
                        c.append(v)
                    tails[tail] += 1
                    full += whole
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n", "part", "tail", "rank_tail", "rank_full", "full_crcs", "tail_crc"])

    return run


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tail_crc long, cut_at long"


def _placing(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for r in batch.to_pylist():
                rows = []
                for k, crc in enumerate(r["full_crcs"]):
                    rows.append((k * plan.window, plan.window, crc, (r["base_full"] or 0) + r["rank_full"] + k, 0, None))
                if r["tail"]:
                    at = len(r["full_crcs"]) * plan.window
                    pieces = place(plan, r["tail"], r["base_tail"] + r["rank_tail"])
                    for length, sequence, offset in pieces:
                        cut = len(pieces) > 1
                        rows.append((at, length, None if cut else r["tail_crc"], sequence, offset, len(r["full_crcs"]) * plan.window + pieces[0][0] if cut else None))
                        at += length
                for start, length, crc, sequence, offset, cut in rows:
                    for c, v in zip(cols, (r["doc_id"], start, length, crc, r["n"], sequence, offset, r["tail_crc"], cut)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in _PIECES.split(", ")])

    return run


def _cutting(path: str, window: int):
    """The crc32 of both halves of cut tails; a text that is not the one meant (of another row with that doc_id) gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                rows = batch.slice(at, 1000)
                out: list[tuple] = []
                rest = rows.drop_columns(["text"]).to_pylist()
                for r, ids in zip(rest, encoder.ended(rows.column(1))):
                    tail = len(ids) // window * window
                    if len(ids) == r["doc_tokens"] and _crc(ids[tail:]) == r["tail_crc"]:
                        out.append((r["doc_id"], r["doc_tokens"], r["tail_crc"], r["cut_at"], _crc(ids[tail : r["cut_at"]]), _crc(ids[r["cut_at"] :])))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(6)], ["doc_id", "doc_tokens", "tail_crc", "cut_at", "crc_1", "crc_2"])

    return run


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of (doc_id, text) in sequences of ``window`` tokens.

    Null and empty texts are one end id. Rows that repeat a doc_id, or a whole row, are packed each. An empty table
    gives no piece. The histogram that comes to the driver has a row for each length up to the window at most.
    """
    path = path or vocabulary_path()
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    base = written(docs.mapInArrow(_measuring(path, window), _MEASURED), "lengths")
    full = F.size("full_crcs").cast("long")
    by_part = base.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("n_tail"), F.sum(full).alias("n_full"))
    by_part = written(by_part, "length-counts")
    ahead = Window.partitionBy("tail").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tails = by_part.select("part", "tail", F.coalesce(F.sum("n_tail").over(ahead), F.lit(0).cast("long")).alias("base_tail"))
    wholes = by_part.groupBy("part").agg(F.sum("n_full").alias("n_full"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wholes = wholes.select("part", F.coalesce(F.sum("n_full").over(ahead), F.lit(0).cast("long")).alias("base_full"))
    counted = by_part.groupBy("tail").agg(F.sum("n_tail").alias("n"), F.sum("n_full").alias("f")).collect()
    histogram = {r["tail"]: r["n"] for r in counted if r["tail"]}
    histogram[window] = sum(r["f"] for r in counted)
    plan = make_plan(histogram, window)
    places = written(tails.join(wholes, "part"), "length-bases")
    # Both sides grow with the corpus, so neither is broadcast; a task's own number is in the key, so no key is hot.
    rows = base.hint("merge").join(places.hint("merge"), ["part", "tail"]).select("doc_id", "n", "tail", "rank_tail", "rank_full", "full_crcs", "tail_crc", "base_tail", "base_full")
    pieces = written(rows.mapInArrow(_placing(plan), _PIECES), "pieces")
    discard(base, by_part, places)
    cuts = written(pieces.where("cut_at IS NOT NULL").select("doc_id", "doc_tokens", "tail_crc", "cut_at").distinct(), "cuts")
    texts = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["doc_id"])).select(docs["doc_id"], docs["text"], "doc_tokens", "tail_crc", "cut_at")
    halves = written(texts.mapInArrow(_cutting(path, window), "doc_id long, doc_tokens long, tail_crc long, cut_at long, crc_1 long, crc_2 long").distinct(), "halves")
    whole = pieces.where("cut_at IS NULL")
    p, h = pieces.where("cut_at IS NOT NULL").alias("p"), halves.alias("h")
    same = F.col("p.doc_id").eqNullSafe(F.col("h.doc_id"))
    for c in ("doc_tokens", "tail_crc", "cut_at"):
        same = same & (F.col(f"p.{c}") == F.col(f"h.{c}"))
    crc = F.when(F.col("p.start") < F.col("p.cut_at"), F.col("h.crc_1")).otherwise(F.col("h.crc_2")).alias("ids_crc32")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    cut = p.join(h, same).select("p.doc_id", "p.start", "p.length", crc, "p.doc_tokens", "p.sequence_id", "p.offset")
    return whole.select(*out).unionByName(cut.select(*out))


def sequences(docs: DataFrame, pieces: DataFrame, path: str | None = None, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, ids (array<int>, padded to ``window`` unless its length is a power of two), of pieces of documents with unique doc_ids."""
    path = path or vocabulary_path()
    ship(docs.sparkSession)
    wanted = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("p"))
    rows = docs.select("doc_id", "text").join(wanted, "doc_id").select("text", "p")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            out = [
                (x["sequence_id"], x["offset"], ids[x["start"] : x["start"] + x["length"]].astype(np.int32))
                for ids, p in zip(encoder.ended(batch.column(0)), batch.column(1).to_pylist()) for x in p
            ]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"])

    parts = rows.mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    power = F.bit_count(n) == 1
    return whole.select("sequence_id", F.when(power | (n >= window), F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad), window - n))).alias("ids"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents``. Null and empty texts are one end id, repeated rows are packed each, an empty table gives no piece."""
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As ``op7_packing``, of what the stages before kept."""
    return pack(docs)
