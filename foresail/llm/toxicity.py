"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of a lexicon, its hits near the second person, capitals,
punctuation and obfuscation. Part of the lexicon is learned: words and word beginnings
that mark toxic texts in many different contexts (a copied text gives the same few
contexts however often it is copied, and so no term). The model is fitted on a
bounded sample of labelled rows (``MAX_ROWS`` of each class, by hash of the id); every document is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, ship, table, written

MAX_ROWS = 8_000  #: labelled rows of each class that a fit uses at most
PREFIXES = (4, 5, 6, 7, 8)
#: A term stands in so many different contexts of toxic texts, so many times as often as in others; STRONG ones count apart.
LEAST_CONTEXTS, LEAST_ODDS, STRONG = 8, 4.0, 20.0

# Insults, and second-person words of four languages.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb scum trash loser losers pathetic worthless disgusting clown fool imbecile jerk "
    "dummkopf abschaum trottel versager idioten con connard imbécile crétin ordure débile tonto estúpido imbécil basura escoria inútil".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su".split())
LOG_STRONG = float(np.log(STRONG))
LEET = str.maketrans("013457@$!|", "oieastasil")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"(?<![^\W_])[^\W\d_]+[0-9@$!|*][0-9@$!|*]*[^\W\d_]+")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_* ]){3,}[^\W\d_](?!\w)")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_SHOUT = re.compile(r"[!?]")

FEATURES = (
    "strong_hits", "strong_density", "strong_kinds", "mild_hits", "mild_density", "weight_density", "weight_sum", "insult_hits", "insult_density", "near_second", "second_density",
    "capital_share", "shout_density", "punctuation_density", "mixed_rate", "spaced_rate", "drawn_rate", "hidden_hits", "log_words",
)


def _terms(words: list[str]) -> set[str]:
    """Words, and beginnings of words marked by a star, of four letters or more."""
    out = {w for w in words if len(w) >= 3}
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    """Terms with the log of their odds."""

    weights: dict[str, float]

    def __post_init__(self) -> None:
        self.starts = frozenset(t[:3] for t in self.weights)

    def weight(self, word: str) -> float:
        """The largest weight of the word and its beginnings, 0 of none."""
        get = self.weights.get
        return max(get(word, 0.0), *[get(word[:n] + "*", 0.0) for n in PREFIXES if len(word) > n], 0.0)

    def hits(self, words: list[str]) -> list[tuple[int, float]]:
        starts, weight = self.starts, self.weight
        found = [(i, weight(w)) for i, w in enumerate(words) if w[:3] in starts]
        return [x for x in found if x[1]]


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The features of one whole text, in the order of FEATURES; an empty text gives zeros."""
    lower = text.lower()
    words = _WORD.findall(lower)
    n = max(len(words), 1)
    hits = lexicon.hits(words)
    strong = [i for i, w in hits if w >= LOG_STRONG]
    weight = sum(w for _, w in hits)
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    second = sum(w in SECOND for w in words)
    near = 0
    for i in set(strong) | set(insults):
        near += any(w in SECOND for w in words[max(0, i - 5) : i + 6])
    mixed = _MIXED.findall(lower)
    spaced = _SPACED.findall(lower)
    spaced = [re.sub(r"[.\-_* ]", "", x) for x in spaced]
    drawn = len(_DRAWN.findall(lower))
    plain = [x.translate(LEET).replace("*", "") for x in mixed] + spaced
    if drawn:
        plain += _WORD.findall(_DRAWN.sub(r"\1", lower))
        plain = plain if len(plain) != len(words) or plain != words else []
    hidden = max(0, sum(w >= LOG_STRONG for _, w in lexicon.hits(plain)) + sum(x in INSULTS for x in plain) - (len(strong) + len(insults) if drawn else 0)) if plain else 0
    chars = max(len(text), 1)
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = len(text) - sum(map(len, words)) - lower.count(" ") - lower.count("\n")
    return [
        len(strong), 100 * len(strong) / n, len({words[i][:4] for i in strong}),
        len(hits), 100 * len(hits) / n, 100 * weight / n, weight, len(insults), 100 * len(insults) / n, near, 100 * second / n,
        upper / chars, 100 * len(_SHOUT.findall(lower)) / n, marks / chars, 100 * len(mixed) / n, 100 * len(spaced) / n, 100 * drawn / n, hidden, float(np.log1p(len(words))),
    ]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> DataFrame:
    """(doc_id, text, toxic, half) of the labelled rows that a fit uses: at most ``most`` of each class.

    Rows without a label are out, a doc_id labelled more than once counts as toxic if any label says so, and rows whose
    crc32(doc_id) is 0 modulo 5 are never used. Those with the least hash of their id are chosen. Lexicon and trees use different halves.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64(F.concat(F.lit("fit"), F.col("doc_id").cast("string")))
    chosen = None
    for c in (0, 1):
        part = known.where(F.col("toxic") == c).withColumn("h", order).orderBy("h", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    chosen = chosen.select("doc_id", "toxic", (F.pmod("h", F.lit(2)) == 0).cast("int").alias("half"))
    # 2 * most rows of three numbers at most, so this side may go to every executor.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic].update(_terms(_WORD.findall((text or "").lower())))
    for toxic, c in counts.items():
        names = list(c)
        for at in range(0, len(names), 1 << 16):
            part = names[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic] * len(part), pa.int32()), pa.array([c[x] for x in part], pa.int64())], ["term", "toxic", "n"])


def _contexts(candidates: frozenset[str]):
    starts = frozenset(t[:3] for t in candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, int, int]] = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                last = ""
                for w in _WORD.findall((text or "").lower()):
                    for t in (w, *[w[:n] + "*" for n in PREFIXES if len(w) > n]) if w[:3] in starts else ():
                        if t in candidates:
                            found.add((t, zlib.crc32(last.encode()), toxic))
                    last = w
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())], ["term", "context", "toxic"])

    return run


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Terms of (text, toxic) that stand in at least LEAST_CONTEXTS different contexts of toxic texts and LEAST_ODDS times as often as in others."""
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(1):
        return Lexicon({})
    ratio = totals.get(0, 0) / totals[1]
    counts = rows.select("text", "toxic").mapInArrow(_frequencies, "term string, toxic int, n long")
    by_term = counts.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("q"))
    odds = (F.col("p") * ratio + 0.5) / (F.col("q") + 0.5)
    # Bounded by the sample: each of them stands in LEAST_CONTEXTS of its toxic texts at least.
    candidates = frozenset(r["term"] for r in by_term.where((F.col("p") >= LEAST_CONTEXTS) & (odds >= LEAST_ODDS)).select("term").collect())
    seen = rows.select("text", "toxic").mapInArrow(_contexts(candidates), "term string, context long, toxic int")
    kinds = seen.distinct().groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q"))
    odds = (F.col("p") * ratio + 0.5) / (F.col("q") + 0.5)
    kept = kinds.where((F.col("p") >= LEAST_CONTEXTS) & (odds >= LEAST_ODDS)).select("term", F.log(odds).alias("w"))
    return Lexicon({r["term"]: r["w"] for r in kept.orderBy("term").collect()})


class Trees:
    """Boosted regression trees of one depth for the logistic loss, grown on quantile bins."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, bins: int = 48):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        leaves = 1 << self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=np.int64)
            cuts: list[tuple[int, float]] = []
            for level in range(self.depth):
                chosen = []
                for k in range(1 << level):
                    chosen.append(self._split(binned, edges, g, h, node == k))
                go = np.zeros(len(y), dtype=np.int64)
                for k, (f, b, cut) in enumerate(chosen):
                    mask = node == k
                    go[mask] = binned[mask, f] > b
                    cuts.append((f, cut))
                node = 2 * node + go
            value = -np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge) * self.rate
            raw += value[node]
            self.trees.append((np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts]), value))
        return self

    def _split(self, binned, edges, g, h, mask) -> tuple[int, int, float]:
        best, out = 1e-9, (0, self.bins + 1, np.inf)
        gs, hs, rows = g[mask], h[mask], binned[mask]
        if not len(gs):
            return out
        total = gs.sum() ** 2 / (hs.sum() + self.ridge)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            a, b = np.cumsum(np.bincount(rows[:, f], gs, len(e) + 1))[:-1], np.cumsum(np.bincount(rows[:, f], hs, len(e) + 1))[:-1]
            gain = a * a / (b + self.ridge) + (gs.sum() - a) ** 2 / (hs.sum() - b + self.ridge) - total
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, out = gain[k], (f, k, float(e[k]))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, cut, value in self.trees:
            node, at = np.zeros(len(x), dtype=np.int64), 0
            for level in range(self.depth):
                k = at + node
                node = 2 * node + (x[rows, f[k]] > cut[k])
                at += 1 << level
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x with weights w, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2], b[3]])
    knots = [(b[2], b[0]) for b in blocks] + [(b[3], b[0]) for b in blocks]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        x = np.array([features(t or "", self.lexicon) for t in texts]).reshape(-1, len(FEATURES))
        raw = self.trees.raw(x)
        step = np.interp(raw, *self.knots)
        # A trace of the trees' own order keeps texts apart where the steps are flat.
        return np.clip(0.998 * step + 0.002 / (1 + np.exp(-raw)), 0, 1)


def _featured(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "toxic", "h"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_ROWS) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic). Without a row of either class every score is the share of toxic rows, 0.5 of none."""
    ship(docs.sparkSession)
    rows = written(training_rows(docs, labels, most), "toxic-rows")
    lexicon = learn_lexicon(rows.where("half = 0"))
    order = F.xxhash64(F.concat(F.lit("calibrate"), F.col("doc_id").cast("string")))
    seen = rows.where("half = 1").select("text", "toxic", order.alias("h")).mapInArrow(_featured(lexicon), "x array<double>, toxic int, h long")
    got = seen.orderBy("h").toArrow()
    discard(rows)
    y = got.column("toxic").to_numpy().astype(float)
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    prior = 0.5 if known is None else float(known)
    if y.sum() == 0 or y.sum() == len(y):
        return Model(lexicon, None, (np.zeros(1), np.zeros(1)), prior)
    x = np.array(got.column("x").to_pylist())
    last = (got.column("h").to_numpy() % 4) == 0
    if len(np.unique(y[last])) < 2 or len(np.unique(y[~last])) < 2:
        last = np.zeros(len(y), dtype=bool)
    trees = Trees().fit(x[~last], y[~last])
    use = last if last.any() else np.ones(len(y), dtype=bool)
    raw, target = trees.raw(x[use]), y[use]
    share = target.mean()
    # The sample holds the classes in other shares than the labels do.
    weight = np.where(target == 1, prior / share, (1 - prior) / (1 - share))
    return Model(lexicon, trees, isotonic(raw, target, weight), prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (doc_id, text); null text is empty and gets a score too."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.scores(part.column(1).to_pylist()))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``. Null and empty texts have a score too, a null doc_id is not held out, repeated rows each have a row, an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
