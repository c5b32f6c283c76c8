"""Toxicity of whole texts: boosted trees over dense features, calibrated isotonically; trained in numpy."""

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import fold, saved, texts

#: At most so many distinct labelled texts of each class are fitted on, chosen by their hash.
SAMPLE_PER_CLASS = 6000
#: Most entries the learned lexicon may have.
LEXICON_ENTRIES = 4000
REJECT = 0.7

#: Insults known without labels, by weight of one entry; the learned lexicon adds to them.
SEED_WORDS = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting",
    "dumb", "fool", "imbecile", "bastard", "asshole", "bitch", "shit", "fuck", "fucking",
    "dummkopf", "arschloch", "scheiße", "blödmann", "abschaum", "trottel",
    "connard", "salaud", "merde", "crétin", "imbécile", "abruti",
    "idiota", "imbécil", "estúpido", "basura", "mierda", "gilipollas", "cabrón",
)
SEED_WEIGHT = 3.0
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vosotros tus".split()
)
FEATURES = (
    "hits", "density", "heaviest", "weight_density", "distinct_hits", "near_you", "capitals", "punctuation",
    "exclamations", "obfuscated", "stretched", "words",
)

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»¿¡…–—’‘"
_NOT_LETTER = regex.compile(r"[^\p{L}\p{M}]+")
#: Look-alike characters and the letters they stand for.
_PLAIN = str.maketrans("013457@$!|+", "oieastasiit")
_NEAR = 5
_MARKS = np.frombuffer(b"?!.,;:*#$%&@", np.uint8)


def _prefixes(word: str) -> list[str]:
    """The entries a word can match: itself, or a beginning of 4 to 6 letters followed by *."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float]
    starts: frozenset = field(init=False)

    def __post_init__(self):
        self.starts = frozenset(entry.rstrip("*")[:2] for entry in self.weights)

    def weight(self, word: str) -> float:
        if word[:2] not in self.starts:
            return 0.0
        return max(self.weights.get(entry, 0.0) for entry in _prefixes(word))


def plain_words(low: str) -> tuple[list[str], int]:
    """The words of a lowered text in order, without marks around them, and how many had signs for letters inside.

    Words joined by a hyphen or an apostrophe are taken apart; in others, signs that
    look like letters become those letters and the rest goes.
    """
    out, obfuscated = [], 0
    for word in low.split():
        if word.isalpha():
            out.append(word)
            continue
        core = word.strip(_EDGES)
        if core.isalpha():
            out.append(core)
        elif any(map(str.isalpha, core)):
            if "-" in core or "'" in core or "’" in core:
                out += filter(None, _NOT_LETTER.split(core))
            else:
                obfuscated += 1
                out.append(_NOT_LETTER.sub("", core.translate(_PLAIN)))
    return out, obfuscated


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense features of a whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    words, obfuscated = plain_words(low)
    starts, hits, total, heaviest, distinct = lexicon.starts, [], 0.0, 0.0, set()
    for i, word in enumerate(words):
        if word[:2] in starts and (weight := lexicon.weight(word)) > 0:
            hits.append(i)
            total += weight
            heaviest = max(heaviest, weight)
            distinct.add(word)
    near = sum(not SECOND_PERSON.isdisjoint(words[max(0, i - _NEAR) : i + _NEAR + 1]) for i in hits)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    same = (raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[:-2] >= 65)
    n, size = max(len(words), 1), len(raw)
    return [
        math.log1p(len(hits)), len(hits) / n, heaviest, total / n, math.log1p(len(distinct)), near / n,
        float(counts[65:91].sum()) / size, float(counts[_MARKS].sum()) / size, float(counts[33]) / size,
        obfuscated / n, float(same.any()), math.log1p(len(words)),
    ]


# -- boosted trees and calibration, in numpy ---------------------------------------


@dataclass
class Trees:
    """Depth-limited regression trees on quantile bins, fitted to the logistic loss by Newton steps."""

    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    least: int = 5
    ridge: float = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = self._codes(x)
        rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees = []
        margin = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(codes, p - y, p * (1 - p), np.arange(len(y)), 0)
            self.trees.append(tree)
            margin += self.rate * self._leaves(tree, codes)
        return self

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def _grow(self, codes, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        leaf = float(-g / (h + self.ridge))
        if depth == self.depth or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j in range(codes.shape[1]):
            size = len(self.edges[j]) + 1
            column = codes[rows, j]
            gs, hs = np.bincount(column, grad[rows], size).cumsum(), np.bincount(column, hess[rows], size).cumsum()
            ns = np.bincount(column, minlength=size).cumsum()
            gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
            gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
            cut = int(gain.argmax())
            if gain[cut] > best[0]:
                best = (gain[cut], j, cut)
        if best[1] is None:
            return leaf
        left = codes[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(codes, grad, hess, rows[left], depth + 1), self._grow(codes, grad, hess, rows[~left], depth + 1))

    def _leaves(self, tree, codes: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(codes), tree)
        return np.where(codes[:, tree[0]] <= tree[1], self._leaves(tree[2], codes), self._leaves(tree[3], codes))

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.base + self.rate * sum((self._leaves(t, codes) for t in self.trees), np.zeros(len(x)))


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of rising margin whose rates rise: pool adjacent violators, each block smoothed by half a row of either class."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest margin, highest margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    at = [edge for b in blocks for edge in (b[2], b[3])]
    rate = [(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)]
    return np.array(at), np.maximum.accumulate(np.array(rate)) if rate else np.array(rate)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: Trees | None
    at: np.ndarray
    rate: np.ndarray

    def score(self, values: list[str]) -> np.ndarray:
        if not values:
            return np.zeros(0)
        x = np.array([features(v, self.lexicon) for v in values])
        if self.trees is None:  # no labels of both classes: only the seed lexicon speaks
            return np.where(x[:, 0] > 0, 0.75, 0.05)
        return np.clip(np.interp(self.trees.margin(x), self.at, self.rate), 0, 1)


# -- fitting on a bounded sample, scoring everything --------------------------------


def _sample(docs: DataFrame, labels: DataFrame, per_class: int, label: str) -> DataFrame:
    """text, y, part of at most per_class distinct texts of each class: those with the smallest hashes."""
    rows = texts(docs)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(
        "doc_id is not null and y in (0, 1)"
    )
    marks = marks.where(fold(F.col("doc_id")) != 1).groupBy("doc_id").agg(F.max("y").alias("y"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("key")).join(marks, "doc_id")
    distinct = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    chosen = None
    for value in (0, 1):
        top = distinct.where(F.col("y") == value).orderBy("key").limit(per_class)
        chosen = top if chosen is None else chosen.union(top)
    chosen = saved(chosen, "sample")
    # Rows that repeat a chosen one are one text again, per task first.
    return (
        rows.join(F.broadcast(chosen.select("doc_id", "key", "y")), "doc_id")
        .where(F.xxhash64("text") == F.col("key"))
        .groupBy("key", "y")
        .agg(F.first("text").alias("text"))
        .select("text", "y", F.pmod(F.col("key"), F.lit(10)).cast("int").alias("part"))
    )


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            entries, ys = [], []
            for text, y in zip(batch.column(0)[start : start + 200].to_pylist(), batch.column(1)[start : start + 200].to_pylist(), strict=True):
                own = {entry for word in set(plain_words(text.lower())[0]) for entry in _prefixes(word)}
                entries += own
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(ys, pa.int32())], ["entry", "y"])


def learn_lexicon(sample: DataFrame, entries: int = LEXICON_ENTRIES) -> Lexicon:
    """Words and beginnings that labelled toxic texts hold far more often than clean ones; counted by Spark.

    An entry counts if its log-odds are above 1 even two standard errors lower.
    """
    sizes = {row["y"]: row["count"] for row in sample.groupBy("y").count().collect()}
    weights = dict.fromkeys(SEED_WORDS, SEED_WEIGHT)
    if sizes.get(0) and sizes.get(1):
        counts = (
            sample.select("text", "y")
            .mapInArrow(_entries, "entry string, y int")
            .groupBy("entry")
            .agg(F.sum("y").alias("k"), F.sum(F.lit(1) - F.col("y")).alias("c"))
        )
        odds = F.log((F.col("k") + 0.5) / (sizes[1] + 1)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1))
        error = F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("c") + 0.5))
        best = counts.where("k >= 3").select("entry", odds.alias("w"), (odds - 2 * error).alias("sure")).where("sure > 1")
        for row in best.orderBy(F.desc("sure"), "entry").limit(entries).collect():
            weights[row["entry"]] = row["w"]
    return Lexicon(weights)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, label: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows outside the held-out fold: half of the sample for the lexicon, the rest for trees and calibration.

    Rows without a label, without a doc_id or with another label than 0 or 1 are left out; a
    document labelled twice counts as toxic if one label says so.
    """
    sample = saved(_sample(docs, labels, per_class, label), "sample")
    lexicon = learn_lexicon(sample.where("part < 5"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(text, lexicon) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "y", "part"]
            )

    rest = sample.where("part >= 5").mapInArrow(featurise, "x array<double>, y int, part int").orderBy("part", "y", "x").toArrow()
    x = np.array(rest.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y, part = rest.column("y").to_numpy().astype(float), rest.column("part").to_numpy()
    fit, hold = part < 8, part >= 8
    if any(len(set(y[rows])) < 2 for rows in (fit, hold)):
        return ToxicityModel(lexicon, None, np.zeros(0), np.zeros(0))
    trees = Trees().fit(x[fit], y[fit])
    at, rate = isotonic(trees.margin(x[hold]), y[hold])
    return ToxicityModel(lexicon, trees, at, rate)


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score of every row; the model travels with the task, no row is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                scores = model.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def with_score(docs: DataFrame, model: ToxicityModel, into: str = "score") -> DataFrame:
    """All columns of docs and the score of their text."""
    from pyspark.sql.pandas.functions import arrow_udf

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [model.score(column.slice(i, 500).to_pylist()) for i in range(0, len(column), 500)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(into, score(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = REJECT, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Null and empty texts get the score of a text whose features are all zero. Repeated
    rows give repeated results. Without labels of both classes the seed lexicon decides.
    """
    model = train(docs, labels, per_class)
    return scored(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
