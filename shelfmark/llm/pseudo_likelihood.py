"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both of its sides."""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import batches_of, saved, texts
from shelfmark.llm.words import ENDING, mix, word_hashes

#: Classes: each of the FREQUENT most frequent words; the others by their last two bytes, the ENDINGS commonest of which
#: have a class each and the rest one together; and the text's edge. The network predicts a word's class, the counts of
#: all words by the kind of their sides the word in its class.
FREQUENT = 32
ENDINGS = 94
SIDE = 3
HIDDEN = 16
#: Every token of all texts is trained on in one of the rounds, picked by its hash and place. A round takes WARM times the
#: tokens of all rounds before it, so partitions of any size go through most tokens from weights that all texts gave.
ROUNDS = 2
WARM = 8
BATCH = 512
SLAB = 128
#: Words of a block of texts whose distinct words are joined with the counts.
BLOCK = 1 << 20
#: Of an Arrow batch, about a block: a task holds several batches in the JVM and in Python, whatever its share of the input.
BATCH_SIZE = "8m"
RATE = 0.1
#: A token's sides are of one of 2 ** SIGNS kinds.
SIGNS = 3
#: Counts by kind that tasks get of the most frequent words; those of all others are joined.
COMMON = 1 << 17
#: Logits less apart than this have exponentials that single precision holds without loss.
APART = 80

REST = FREQUENT + ENDINGS
EDGE = REST + 1
SIZE = EDGE + 1
#: Tokens whose neighbours are held together.
STRETCH = 1 << 16
_CLASS = np.uint8 if SIZE <= 1 << 8 else np.uint16
_BLOCK_TYPES = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), *map(pa.list_, (pa.int64(), pa.int32(), pa.int64()))]
_BLOCK_NAMES = ["block", "doc_id", "n_tokens", "tokens", "turns", "words", "at", "n_at"]
_SCORED = ["block", "doc_id", "n_tokens", "sums", "at", "n_at"]
_OFFSETS = np.array([d for d in range(-SIDE, SIDE + 1) if d])


def product(a: np.ndarray, b: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """``a @ b`` by SLAB rows: products too small for BLAS to start threads, which only take cores from other tasks."""
    out = np.empty((len(a), b.shape[1]), np.float32) if out is None else out
    whole = len(a) // SLAB * SLAB
    np.matmul(a[:whole].reshape(-1, SLAB, a.shape[1]), b, out=out[:whole].reshape(-1, SLAB, b.shape[1]))
    np.matmul(a[whole:], b, out=out[whole:])
    return out


def inner_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b``, likewise."""
    whole = len(a) // SLAB * SLAB
    slabs = a[:whole].reshape(-1, SLAB, a.shape[1]).transpose(0, 2, 1) @ b[:whole].reshape(-1, SLAB, b.shape[1])
    return slabs.sum(0) + a[whole:].T @ b[whole:]


@dataclass
class Network:
    """p(token | neighbours): one table per neighbour's place, a tanh layer, a softmax over all tokens but the edge."""

    tables: np.ndarray  # (2 * SIDE, SIZE, HIDDEN)
    bias: np.ndarray
    out: np.ndarray  # (HIDDEN, EDGE)
    prior: np.ndarray

    @classmethod
    def new(cls, prior: np.ndarray) -> "Network":
        random = np.random.default_rng(0)
        return cls(
            random.normal(0, 0.1, (2 * SIDE, SIZE, HIDDEN)).astype(np.float32),
            np.zeros(HIDDEN, np.float32),
            random.normal(0, 0.1, (HIDDEN, EDGE)).astype(np.float32),
            prior.astype(np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.out, self.prior]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float64)

    def filled(self, flat: np.ndarray) -> "Network":
        made, at = [], 0
        for p in self.parts():
            made.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*made)

    def squares(self) -> "Network":
        """Where sums of squared gradients begin."""
        return Network(*(np.full(p.shape, 1e-6, np.float32) for p in self.parts()))

    def copy(self) -> "Network":
        return Network(*(p.copy() for p in self.parts()))

    def hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.tables[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.tables[k].take(around[:, k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    @cached_property
    def room(self) -> np.ndarray:
        return np.empty((BATCH, EDGE), np.float32)

    def logits(self, hidden: np.ndarray) -> np.ndarray:
        """Of at most BATCH rows, less the largest of all, or less each row's if they are further apart than ``exp`` allows; the next call writes over them."""
        found = product(hidden, self.out, self.room[: len(hidden)])
        found += self.prior
        top = found.max()
        found -= top if top - found.min() < APART else found.max(1, keepdims=True)
        return found

    def log_probabilities(self, around: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural log-probability of each token given the neighbours in the rows of ``around``."""
        out = np.empty(len(token), np.float64)
        for at in range(0, len(token), BATCH):  # so many logits stay in a core's cache
            logits = self.logits(self.hidden(around[at : at + BATCH]))
            mine = logits[np.arange(len(logits)), token[at : at + BATCH]]
            out[at : at + BATCH] = mine - np.log(np.einsum("ij->i", np.exp(logits, out=logits)))
        return out

    def step(self, around: np.ndarray, token: np.ndarray, rate: float, past: "Network | None" = None) -> None:
        """One step down the mean gradient; with ``past``, each weight's by the root of its squares so far."""

        def scaled(at: int, gradient: np.ndarray, rows=slice(None)) -> np.ndarray:
            if past is None:
                return rate * gradient
            sums = past.parts()[at].reshape(-1, *gradient.shape[1:])
            squares = gradient * gradient
            squares += sums[rows]
            sums[rows] = squares
            gradient *= np.float32(rate)
            gradient /= np.sqrt(squares, out=squares)
            return gradient

        hidden = self.hidden(around)
        p = self.logits(hidden)
        np.exp(p, out=p)
        sums = np.einsum("ij->i", p)
        p[np.arange(len(p)), token] -= sums
        # Each row of p still lacks this factor; it goes to the narrow side of the products.
        factor = (np.float32(1 / len(p)) / sums)[:, None]
        inner = product(p, np.ascontiguousarray(self.out.T))
        inner *= factor * (1 - hidden * hidden)
        self.out -= scaled(2, inner_product(factor * hidden, p))
        self.prior -= scaled(3, inner_product(factor, p)[0])
        self.bias -= scaled(1, inner.sum(0))
        # Rows of a table that several tokens share get the sum, over runs of equal rows.
        rows = (around + np.arange(2 * SIDE) * SIZE).ravel().astype(np.int16)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        rows = rows[first]
        summed = np.add.reduceat(inner.take(order.astype(np.int32) // (2 * SIDE), axis=0), first, axis=0)
        self.tables.reshape(-1, HIDDEN)[rows] -= scaled(0, summed, rows)


def neighbours(tokens: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """For each token (or those at some places) the SIDE before and the SIDE after it; EDGE beyond the text."""
    padded = np.concatenate([np.full(SIDE, EDGE), tokens, np.full(SIDE, EDGE)])
    if places is not None:
        return padded[places[:, None] + (SIDE + _OFFSETS)]
    return np.stack([padded[SIDE + d : SIDE + d + len(tokens)] for d in _OFFSETS], 1)


def edged(sizes: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid side by side with SIDE edges around each, and the place of each token there."""
    places = np.arange(len(tokens)) + SIDE * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(tokens) + SIDE * (len(sizes) + 1), EDGE)
    padded[places] = tokens
    return padded, places


class Vocabulary:
    """Class numbers of word hashes (the place among the frequent words, or that of the ending), and how often each word occurs.

    The counts stay a table of Spark, with a row for each distinct word; tasks get the rest.
    """

    def __init__(self, frequent: list[int], counts: DataFrame, endings: list[int] = ()):
        hashes = np.array(frequent, np.int64).view(np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.counts = counts
        self.of_ending = np.full(int(ENDING) + 1, REST)
        self.of_ending[list(endings)] = FREQUENT + np.arange(len(endings))
        self.seen = np.ones(EDGE)  # occurrences of each class, and one for a word that was not counted

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "counts"}

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        other = self.of_ending[(hashes & ENDING).astype(np.int64)]
        if not len(self.sorted):
            return other
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], other)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, hashes in word_hashes(batch.column(0), True):
            words, counts = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], ["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, as its 64-bit hash with its ending, occurs in all texts."""
    return texts(docs).select("text").mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _blocks(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, rounds: int, block: int) -> Iterator[pa.RecordBatch]:
    """Texts (doc_id, text), tokenised, in blocks that are numbered from ``block``; one ends after BLOCK words or one longer text.

    ``tokens`` has the class of each word and ``turns`` the round that trains on it, text by text, a byte each, ``n_tokens`` of
    them in a text. ``words`` has each of the block's words that share a class once, in order of its hash; ``at`` the place
    there of each occurrence, ``n_at`` of them in a text.
    """
    limits = np.array([WARM**turn for turn in range(rounds - 1)], np.uint64)
    ids, sizes, classes, turns, words, n_at, held = [], [], [], [], [], [], 0

    def made() -> pa.RecordBatch:
        every, at = np.unique(np.concatenate(words), return_inverse=True)
        columns = (ids, sizes, np.concatenate(classes).tobytes(), np.concatenate(turns).tobytes(), every.view(np.int64), at.astype(np.int32), n_at)
        arrays = [pa.array([c], t) for c, t in zip(columns, _BLOCK_TYPES, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *arrays], _BLOCK_NAMES)

    for batch in batches:
        for start, end, lists in word_hashes(batch.column(1), True):
            for doc_id, hashes in zip(batch.column(0)[start:end].to_pylist(), lists, strict=True):
                tokens = vocabulary.tokens(hashes)
                picked = mix(hashes + np.arange(len(hashes), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                picked %= np.uint64(WARM ** (rounds - 1))
                turn = np.searchsorted(limits, picked, side="right") if rounds > 2 else picked >= limits[0] if rounds > 1 else np.zeros(len(picked))
                other = hashes[tokens >= FREQUENT]
                for column, value in ((ids, doc_id), (sizes, len(hashes)), (classes, tokens.astype(_CLASS)), (turns, turn.astype(np.uint8)), (words, other), (n_at, len(other))):
                    column.append(value)
                held += len(hashes) + 1
                if held >= BLOCK:
                    yield made()
                    block += 1
                    ids, sizes, classes, turns, words, n_at, held = [], [], [], [], [], [], 0
    if ids:
        yield made()


def tokenised(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> DataFrame:
    """The texts as blocks of tokens, saved: all rounds and the scores read them, so words are hashed once after they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _blocks(batches, vocabulary, rounds, TaskContext.get().partitionId() << 32)

    kinds = "block long, doc_id array<long>, n_tokens array<long>, tokens binary, turns binary, words array<long>, at array<int>, n_at array<long>"
    return saved(texts(docs).mapInArrow(run, kinds), "blocks", together=1)


def _sizes_and_bytes(batch: pa.RecordBatch, row: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    sizes = batch.column("n_tokens")[row].values.to_numpy()
    return sizes, np.frombuffer(batch.column(name)[row].as_buffer(), _CLASS if name == "tokens" else np.uint8)


def _learner(network: Network, turn: int, rate: float):
    """The weights after a round over a partition's blocks, each times the tokens trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, past, seen, around, token = network.copy(), network.squares(), 0, [], []

        def learn(final: bool) -> None:
            nonlocal around, token, seen
            a, t = np.concatenate(around), np.concatenate(token)
            whole = len(t) if final else len(t) // BATCH * BATCH
            for at in range(0, whole, BATCH):
                own.step(a[at : at + BATCH], t[at : at + BATCH], rate, past)
            seen += whole
            around, token = [a[whole:]], [t[whole:]]

        for batch in batches:
            for row in range(len(batch)):
                sizes, tokens = _sizes_and_bytes(batch, row, "tokens")
                padded, places = edged(sizes, tokens)
                places = places[_sizes_and_bytes(batch, row, "turns")[1] == turn]
                for at in range(0, len(places), STRETCH):  # a block's neighbours are not held together
                    mine = places[at : at + STRETCH]
                    around.append(padded[mine[:, None] + _OFFSETS])
                    token.append(padded[mine])
                    learn(False)
        if token:
            learn(True)
        if seen:
            flat = own.flat()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat * seen), pa.array(np.full(len(flat), seen), pa.int64())], ["i", "w", "n"]
            )

    return run


def _trainer(network: Network, vocabulary: Vocabulary, turn: int, rounds: int, rate: float):
    """A round over texts that are not tokenised yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), b.column("text")], ["doc_id", "text"]) for b in batches)
        return _learner(network, turn, rate)(_blocks(rows, vocabulary, rounds, 0))

    return run


def learn_vocabulary(docs: DataFrame) -> Vocabulary:
    """Word counts over all texts, the frequent words and the common endings of the others.

    The driver gets the frequent words and the common endings, of fixed size. The counts of all words
    stay in Spark, as the vocabulary's second level.
    """
    counts = saved(word_counts(docs), "counts")
    frequent = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]
    ending = F.col("word").bitwiseAND(F.lit(int(ENDING))).cast("int").alias("ending")
    others = counts.where(~F.col("word").isin(frequent)).groupBy(ending).agg(F.sum("n").alias("n"))
    endings = [r["ending"] for r in others.orderBy(F.desc("n"), "ending").limit(ENDINGS).collect()]
    vocabulary = Vocabulary(frequent, counts, endings)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = vocabulary.tokens(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), batch.column(1)], ["token", "n"])

    seen = {r["token"]: r["n"] for r in counts.mapInArrow(tokenise, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    vocabulary.seen = np.array([seen.get(t, 0) + 1.0 for t in range(EDGE)])
    return vocabulary


def fit(blocks: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Rounds of local training in every partition of the blocks, averaged by tokens seen.

    Each round takes its share of the tokens, so that all of them together take every token once. What is
    gathered (a copy of the weights per partition) is summed by Spark; the driver gets the mean weights, of fixed size.
    """
    network = Network.new(np.log(vocabulary.seen / vocabulary.seen.sum()))
    for turn in range(rounds):
        summed = (
            blocks.select("n_tokens", "tokens", "turns").mapInArrow(_learner(network, turn, rate), "i long, w double, n long")
            .groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
        ).toArrow()
        if not summed.num_rows:
            break
        flat = np.zeros(summed.num_rows)
        flat[summed.column("i").to_numpy()] = summed.column("w").to_numpy()
        network = network.filled(flat)
    return network


def train(docs: DataFrame, rounds: int = ROUNDS, rate: float = RATE) -> tuple[Vocabulary, Network]:
    """The vocabulary of all texts, and the network trained on every token of them."""
    vocabulary = learn_vocabulary(docs)
    return vocabulary, fit(tokenised(docs, vocabulary, rounds), vocabulary, rounds, rate)


@dataclass
class Sides:
    """The kind of a token's sides, and how often each word has sides of each kind: p(word | its class, its sides).

    The kind is the signs of sums over the neighbours, one table per neighbour's place. Of a word, ``n0``, ``n1``, ...
    in ``counts`` (a table of Spark, a row for each distinct word) are its occurrences by kind. One of each kind that it has
    is set aside and dealt to all kinds by the class's ``share``, so a word that occurs once does not know its sides.
    """

    tables: np.ndarray  # (2 * SIDE, SIZE, signs)
    share: np.ndarray  # (EDGE, kinds)
    total: np.ndarray  # (EDGE, kinds): the weights of a class's words, and of one word that was not counted
    counts: DataFrame
    common: np.ndarray  # hashes of the most frequent words, in order
    gains: np.ndarray  # (common words, kinds): their ``gain``

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "counts"}

    @classmethod
    def alike(cls, vocabulary: Vocabulary) -> "Sides":
        """All sides of one kind: a word's share of its class's occurrences."""
        seen = vocabulary.seen[:, None]
        return cls(np.zeros((2 * SIDE, SIZE, 0), np.float32), np.ones(seen.shape), seen, vocabulary.counts.withColumnRenamed("n", "n0"), np.zeros(0, np.uint64), np.zeros((0, 1)))

    @property
    def names(self) -> list[str]:
        return [f"n{k}" for k in range(self.share.shape[1])]

    def kinds(self, around: np.ndarray) -> np.ndarray:
        total = self.tables[0].take(around[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.tables[k].take(around[:, k], axis=0)
        return np.packbits(total > 0, axis=1, bitorder="little")[:, 0] if total.shape[1] else np.zeros(len(around), np.uint8)

    @cached_property
    def once(self) -> np.ndarray:
        """Log-share of a word that occurs once, or was not counted, in each class for each kind; 0 where the class is one word."""
        found = np.log(self.share / self.total)
        found[:FREQUENT] = 0
        return found

    def gain(self, of: np.ndarray, n: np.ndarray) -> np.ndarray:
        """What words of classes ``of`` with counts ``n`` by kind, in rows, have more: 0 for those that occur once."""
        return np.log(np.maximum(n - 1, 0) / self.share[of] + np.maximum((n > 0).sum(1), 1)[:, None])

    def logs(self, words: np.ndarray, n: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
        """Log of each word's share of its class, in rows, for each kind of sides; ``n`` has its counts by kind, 0 if it was not counted."""
        of = vocabulary.tokens(words)
        return self.once[of] + self.gain(of, n)

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where the words are among the common ones; -1 if they are not."""
        if not len(self.common):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.common, words), len(self.common) - 1)
        return np.where(self.common[at] == words, at, -1)


def directions(network: Network, vocabulary: Vocabulary, signs: int = SIGNS) -> np.ndarray:
    """Tables whose sums over the neighbours' places are above 0 or not: the ``signs`` directions that move the network's outputs most.

    The principal axes of the outputs as linear functions of independent neighbours, each as often as its class, less their means.
    """
    often = vocabulary.seen / vocabulary.seen.sum()
    tables = network.tables.astype(np.float64)
    tables -= np.einsum("c,pch->ph", often, tables[:, :EDGE])[:, None]
    spread = np.einsum("c,pch,pcg->hg", often, tables[:, :EDGE], tables[:, :EDGE])
    out = network.out.astype(np.float64)
    out = (out - (out @ often)[:, None]) * np.sqrt(often)
    axes = np.linalg.eigh(out.T @ spread @ out)[1][:, ::-1][:, :signs]
    return (tables @ (out @ axes)).astype(np.float32)


def _kind_counts(sides: Sides):
    """The words of blocks with their counts by kind of sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                sizes, tokens = _sizes_and_bytes(batch, row, "tokens")
                padded, places = edged(sizes, tokens)
                places = places[tokens >= FREQUENT]
                words, at = batch.column("words")[row].values, batch.column("at")[row].values.to_numpy() * np.int64(len(sides.names))
                for start in range(0, len(places), STRETCH):
                    at[start : start + STRETCH] += sides.kinds(padded[places[start : start + STRETCH, None] + _OFFSETS])
                n = np.bincount(at, minlength=len(words) * len(sides.names)).reshape(len(words), -1)
                yield pa.RecordBatch.from_arrays([words, *map(pa.array, np.ascontiguousarray(n.T))], ["word", *sides.names])

    return run


def _class_counts(vocabulary: Vocabulary, names: list[str]):
    """Of words with their counts by kind: occurrences, and words that occur, by class and kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = vocabulary.tokens(batch.column("word").to_numpy().view(np.uint64))
            for kind, name in enumerate(names):
                n = batch.column(name).to_numpy()
                several = np.zeros((2, EDGE), np.int64)
                np.add.at(several[0], of, n)
                several[1] = np.bincount(of[n > 0], minlength=EDGE)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(EDGE)), pa.array(np.full(EDGE, kind)), *map(pa.array, several)], ["token", "kind", "n", "words"])

    return run


def learn_sides(blocks: DataFrame, vocabulary: Vocabulary, network: Network, signs: int = SIGNS) -> Sides:
    """Each word's counts by kind of sides, over all occurrences in the blocks.

    The driver gets their sums by class and those of the COMMON most frequent words, both of fixed size.
    """
    kinds = 1 << signs
    sides = Sides(directions(network, vocabulary, signs), np.ones((EDGE, kinds)), np.ones((EDGE, kinds)), vocabulary.counts, np.zeros(0, np.uint64), np.zeros((0, kinds)))
    counted = blocks.select("n_tokens", "tokens", "words", "at").mapInArrow(_kind_counts(sides), ", ".join(f"{c} long" for c in ["word", *sides.names]))
    sides.counts = saved(counted.groupBy("word").agg(*(F.sum(c).alias(c) for c in sides.names)), "sides")
    summed = sides.counts.mapInArrow(_class_counts(vocabulary, sides.names), "token long, kind long, n long, words long")
    n, words = np.zeros((2, EDGE, kinds))
    for r in summed.groupBy("token", "kind").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect():
        n[r["token"], r["kind"]], words[r["token"], r["kind"]] = r["n"], r["words"]
    sides.share = (n + 1 / kinds) / (n.sum(1, keepdims=True) + 1)
    sides.total = n - words + (words.sum(1, keepdims=True) + 1) * sides.share
    common = sides.counts.orderBy(F.desc(sum(map(F.col, sides.names))), "word").limit(COMMON).toArrow()
    found = common.column("word").to_numpy().view(np.uint64)
    order = np.argsort(found)
    sides.common = found[order]
    if len(order):
        n = np.stack([common.column(c).to_numpy()[order] for c in sides.names], 1)
        sides.gains = sides.gain(vocabulary.tokens(sides.common), n)
    return sides


def _rarer(vocabulary: Vocabulary, sides: Sides):
    """The words of blocks that are not common, with their places and classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, row in zip(batch.column("block").to_pylist(), range(len(batch)), strict=True):
                words = batch.column("words")[row].values.to_numpy().view(np.uint64)
                place = np.flatnonzero(sides.places(words) < 0)
                words = words[place]
                columns = (np.full(len(place), block), place.astype(np.int32), vocabulary.tokens(words).astype(np.int32), words.view(np.int64))
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["in_block", "place", "token", "word"])

    return run


def _scorer(network: Network, sides: Sides):
    """For each text of a block the log-likelihood, but for gains of words that are not common; ``at`` has a place for each of these and kind of sides."""
    kinds, once = len(sides.names), sides.once.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                sizes, tokens = _sizes_and_bytes(batch, row, "tokens")
                padded, places = edged(sizes, tokens)
                common = sides.places(batch.column("words")[row].values.to_numpy().view(np.uint64))
                gains = np.zeros((len(common), kinds))
                gains[common >= 0] = sides.gains[common[common >= 0]]
                gains = gains.ravel()
                at, upto, left = np.zeros(len(tokens), np.int64), np.zeros(len(tokens) + 1), np.zeros(len(tokens) + 1, np.int64)
                shared = np.flatnonzero(tokens >= FREQUENT)
                at[shared] = batch.column("at")[row].values.to_numpy()
                rarer = np.zeros(len(tokens), bool)
                rarer[shared] = common[at[shared]] < 0
                at *= kinds
                for start in range(0, len(tokens), STRETCH):
                    mine = places[start : start + STRETCH]
                    token, around = padded[mine], padded[mine[:, None] + _OFFSETS]
                    kind = sides.kinds(around)
                    at[start : start + STRETCH] += kind
                    found = network.log_probabilities(around, token) + once.take(token * kinds + kind)
                    own = np.flatnonzero(token >= FREQUENT)
                    found[own] += gains[at[start + own]]
                    upto[start + 1 : start + 1 + len(mine)] = upto[start] + np.cumsum(found)
                np.cumsum(rarer, out=left[1:])
                ends = np.concatenate([[0], np.cumsum(sizes)])
                made = {
                    "sums": pa.array([upto[ends[1:]] - upto[ends[:-1]]], pa.list_(pa.float64())),
                    "at": pa.array([at[rarer].astype(np.uint32).view(np.int32)], pa.list_(pa.int32())),
                    "n_at": pa.array([left[ends[1:]] - left[ends[:-1]]], pa.list_(pa.int64())),
                }
                one = batch.slice(row, 1)
                yield pa.RecordBatch.from_arrays([made[c] if c in made else one.column(c) for c in _SCORED], _SCORED)

    return run


def _finish(sides: Sides):
    """The texts of one block, and the counts of its words that are not common and occur more than once: each occurrence adds its word's gain."""

    def run(blocks: pa.Table, counted: pa.Table) -> pa.Table:
        values = {k: blocks.column(k).combine_chunks().flatten() for k in ("doc_id", "n_tokens", "sums", "at", "n_at")}
        at = values["at"].to_numpy().view(np.uint32)
        kinds = len(sides.names)
        gains = np.zeros((int(at.max()) // kinds + 1 if len(at) else 0, kinds))
        if counted.num_rows:
            n = np.stack([counted.column(c).to_numpy() for c in sides.names], 1)
            gains[counted.column("place").to_numpy()] = sides.gain(counted.column("token").to_numpy(), n)
        ends = np.concatenate([[0], np.cumsum(values["n_at"].to_numpy())])
        added = np.concatenate([[0.0], np.cumsum(gains.ravel()[at])])
        total = values["sums"].to_numpy() + added[ends[1:]] - added[ends[:-1]]
        return pa.table([values["doc_id"], values["n_tokens"], pa.array(total)], ["doc_id", "n_tokens", "log_likelihood"])

    return run


def scored(docs: DataFrame, vocabulary: Vocabulary, network: Network, sides: Sides | None = None) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum of the conditional log-probabilities), perplexity; null without tokens.

    A word's probability is that of its class given the neighbours, times the word's share of the
    class's occurrences with ``sides`` of that kind (of all occurrences, without them); all words that were not counted
    share one occurrence of their class. The distinct words of each block of texts, not the tokens, are joined with the counts
    (but the most frequent ones, whose counts all tasks get).
    """
    return score_blocks(tokenised(docs, vocabulary), vocabulary, network, sides)


def score_blocks(blocks: DataFrame, vocabulary: Vocabulary, network: Network, sides: Sides | None = None) -> DataFrame:
    """``scored`` of tokenised texts."""
    sides = sides or Sides.alike(vocabulary)
    words = blocks.select("block", "words").mapInArrow(_rarer(vocabulary, sides), "in_block long, place int, token int, word long")
    counts = sides.counts.where(sum(map(F.col, sides.names)) > 1)
    counted = words.join(counts, "word").select("in_block", "place", "token", *sides.names)
    kinds = "block long, doc_id array<long>, n_tokens array<long>, sums array<double>, at array<int>, n_at array<long>"
    return (
        blocks.drop("turns").mapInArrow(_scorer(network, sides), kinds).groupBy("block").cogroup(counted.groupBy("in_block"))
        .applyInArrow(_finish(sides), "doc_id long, n_tokens long, log_likelihood double")
        .withColumn("perplexity", F.when(F.col("n_tokens") > 0, F.exp(-F.col("log_likelihood") / F.col("n_tokens"))))
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on all texts and score each row's whole text; null and empty texts have no tokens and likelihood 0."""
    with batches_of(docs.sparkSession, BATCH_SIZE):
        vocabulary = learn_vocabulary(docs)
        blocks = tokenised(docs, vocabulary)
        network = fit(blocks, vocabulary)
        return saved(score_blocks(blocks, vocabulary, network, learn_sides(blocks, vocabulary, network)), "scores")
