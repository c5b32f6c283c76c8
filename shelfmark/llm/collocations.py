"""Collocations of words: only the longest windows are counted; a ROLLUP sums shorter phrases out of them.

Most windows of a text occur once, and exchanging their words costs many times the text. So
32-bit hashes of windows and their beginnings are counted first, and a window ends where the hash
of its beginning occurs too seldom: no candidate begins like that. A hash that several
phrases share only keeps more words than needed. The marks are a bitmap of fixed size, whatever the
input; when it fills up, less is pruned, and the results stay the same.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved, small
from shelfmark.llm.words import column_bytes, mix, powers, runs

#: Most words of a phrase, least occurrences of a candidate, phrases listed per language.
ORDER = 3
LEAST = 10
TOP = 2000
#: A phrase goes if a longer one around it has at least this share of its occurrences, in percent.
COVERED_PERCENT = 50
SCALE = 1_000_000
#: Bits of the map of frequent phrases (8 MB), as a power of two; 64 to a word.
MAP_BITS = 26
#: Bytes of a long text that are worked on at a time, up to the next mark.
PIECE = 1 << 20

#: Stands for the words that a window lacks at the end of its piece; no word is empty.
_PAD = ""
_WORD, _SPACE, _MARK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _SPACE
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = _MARK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _columns(order: int) -> list[str]:
    return [f"w{i + 1}" for i in range(order)]


@dataclass
class Words:
    """The lowered words of adjacent texts, one after the other."""

    letters: np.ndarray  # bytes of all words
    lengths: np.ndarray
    text: np.ndarray  # number of the text a word is in
    piece: np.ndarray  # grows at each mark and each text

    def __len__(self) -> int:
        return len(self.lengths)

    def strings(self) -> pa.Array:
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(self.lengths, out=offsets[1:])
        return pa.LargeStringArray.from_buffers(len(self), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(self.letters)))

    def prefixes(self, seeds: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 2 to ``order`` words from each word on: their hash of 32 bits under the text's seed, and whether they are in one piece."""
        first = np.cumsum(self.lengths) - self.lengths
        inside = np.arange(len(self.letters)) - np.repeat(first, self.lengths)
        values = (self.letters + np.uint64(1)) * powers(int(self.lengths.max()))[inside]
        word = mix(np.add.reduceat(values, first) + self.lengths.astype(np.uint64))
        value = word + seeds[self.text]
        for k in range(1, order):
            value = mix(value[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[k:])
            whole = self.piece[k:] == self.piece[: len(self) - k]
            yield (value >> np.uint64(32)).astype(np.uint32), whole


def _words(data: np.ndarray, bounds: np.ndarray) -> Words:
    kind = _KIND[data]
    word = kind == _WORD
    inner = bounds[1:-1]
    inner = inner[inner < len(data)]
    head = word.copy()
    head[1:] &= ~word[:-1]
    head[inner] = word[inner]
    breaks = kind == _MARK
    breaks[inner] = True
    at = np.flatnonzero(head)
    # Letters between two heads belong to the first of them.
    before = np.cumsum(word)[at] - 1 if len(at) else at
    lengths = np.diff(np.append(before, np.count_nonzero(word)))
    return Words(_LOWER[data[word]], lengths, np.searchsorted(bounds, at, side="right") - 1, np.cumsum(breaks)[at])


def _parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and bounds of texts of together about PIECE bytes; a longer text is cut after marks."""
    data, bounds = column_bytes(column)
    for start, end in runs(bounds):
        low, high = int(bounds[start]), int(bounds[end])
        while high - low > PIECE and end == start + 1:
            cut, step = low + PIECE, low + PIECE
            while cut < high and not (marks := np.flatnonzero(_KIND[data[cut : cut + PIECE]] == _MARK)).size:
                cut += PIECE
            step = cut + int(marks[0]) + 1 if cut < high else high
            yield start, data[low:step], np.array([0, step - low])
            low = step
        if high > low:
            yield start, data[low:high], np.maximum(bounds[start : end + 1] - low, 0)


def _seeds(langs: pa.Array) -> np.ndarray:
    """A number per row that follows from its language alone."""
    encoded = langs.dictionary_encode()
    each = [zlib.crc32(value.encode("utf-8", "replace")) for value in encoded.dictionary.to_pylist()]
    return mix(np.array(each, np.uint64))[encoded.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )


def frequent_phrases(docs: DataFrame, order: int = ORDER, least: int = LEAST, text: str = "text", lang: str = "lang") -> np.ndarray:
    """A map of 2^MAP_BITS bits in words of 64: hashes of 2 to ``order`` words met at least ``least`` times in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, found = _seeds(batch.column(0)), [np.zeros(0, np.uint32)]
            for start, data, bounds in _parts(batch.column(1)):
                words = _words(data, bounds)
                if len(words):
                    found += [hashes[whole] for hashes, whole in words.prefixes(seeds[start:], order)]
            hashes, times = np.unique(np.concatenate(found), return_counts=True)
            for i in range(0, len(hashes), 100_000):
                part = [pa.array(hashes[i : i + 100_000].view(np.int32)), pa.array(times[i : i + 100_000])]
                yield pa.RecordBatch.from_arrays(part, ["hash", "f"])

    counts = _texts(docs, text, lang).mapInArrow(count, "hash int, f long").groupBy("hash").agg(F.sum("f").alias("f"))
    at = F.shiftright(F.pmod(F.col("hash").cast("long"), F.lit(2**MAP_BITS)), 6).alias("at")
    mark = F.expr("shiftleft(1L, cast(pmod(hash, 64) as int))").alias("mark")
    filled = counts.where(F.col("f") >= least).select(at, mark).groupBy("at").agg(F.bit_or("mark").alias("marks")).toArrow()
    marks = np.zeros(2 ** (MAP_BITS - 6), np.int64)
    marks[filled.column("at").to_numpy()] = filled.column("marks").to_numpy()
    return marks.view(np.uint64)


def windows(docs: DataFrame, order: int = ORDER, marks: np.ndarray | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, w1 ... w<order>, f: for every word, itself and the words that follow it in its piece, padded with ''.

    The columns of following words are the column of words moved up; equal windows of a part
    of a batch are one row with their number f. With ``marks``, a map of frequent phrases, a window
    is cut after its longest beginning in it. Texts stay where they are.
    """
    names = _columns(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encoded = batch.column(0).dictionary_encode()
            languages, language = encoded.dictionary, encoded.indices.to_numpy()
            seeds = _seeds(batch.column(0))
            for start, data, bounds in _parts(batch.column(1)):
                words = _words(data, bounds)
                if not len(words):
                    continue
                coded = words.strings().dictionary_encode()
                code = coded.indices.to_numpy()
                columns, reaches = [code], np.ones(len(words), bool)
                for i, (hashes, whole) in enumerate(words.prefixes(seeds[start:], order), 1):
                    if marks is not None:
                        bit = hashes & np.uint32(2**MAP_BITS - 1)
                        whole = whole & ((marks[bit >> 6] >> (bit & np.uint32(63)).astype(np.uint64)) & np.uint64(1) == 1)
                    reaches = reaches[: len(whole)] & whole
                    column = np.full(len(words), -1, code.dtype)
                    column[: len(whole)][reaches] = code[i:][reaches]
                    columns.append(column)
                keys = {"lang": language[start + words.text], **dict(zip(names, columns, strict=True))}
                counted = pa.table(keys).group_by(list(keys)).aggregate([([], "count_all")])
                made = [languages.take(counted["lang"].combine_chunks())]
                for name in names:
                    at = counted[name].to_numpy()
                    made.append(coded.dictionary.take(pa.array(at, mask=at < 0)).fill_null(_PAD).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*made, counted["count_all"].combine_chunks()], ["lang", *names, "f"])

    schema = ", ".join(f"{name} string" for name in ["lang", *names])
    return _texts(docs, text, lang).mapInArrow(cut, f"{schema}, f long")


def phrase_counts(docs: DataFrame, order: int = ORDER, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, phrase, f: phrases of 1 to ``order`` words that occur at least ``least`` times; words = 0 has the language's total.

    One exchange counts the longest windows, summed up per task first. Windows below ``least``
    then lose their last word, as no phrase of full length can come of them, and ROLLUP sums
    what begins with the same words. A language and a frequent word are one row per task by
    then, whatever share of the text they hold.
    """
    names = _columns(order)
    pruned = windows(docs, order, frequent_phrases(docs, order, least, text, lang), text, lang)
    longest = pruned.groupBy("lang", *names).agg(F.sum("f").alias("f"))
    last = F.when(F.col("f") >= least, F.col(names[-1])).otherwise(F.lit(_PAD))
    rolled = longest.withColumn(names[-1], last).rollup("lang", *names).agg(F.sum("f").alias("f"), F.grouping_id().alias("gone"))
    # grouping_id has one bit for each column summed over, so 2**i - 1 says that the last i are.
    words = F.lit(None).cast("int")
    for i in range(order + 1):
        words = F.when(F.col("gone") == 2**i - 1, F.lit(order - i)).otherwise(words)
    whole = F.col("words") == 0
    for i, name in enumerate(names):
        whole = whole | ((F.col("words") == i + 1) & (F.col(name) != _PAD))
    return (
        rolled.withColumn("words", words)
        .where(whole & ((F.col("words") == 0) | (F.col("f") >= least)))
        .select("lang", "words", F.concat_ws(" ", *(F.when(F.col("words") > i, F.col(n)) for i, n in enumerate(names))).alias("phrase"), "f")
    )


def _joined(parts: Column, first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(parts, first, length), " ")


def collocations(
    docs: DataFrame,
    order: int = ORDER,
    least: int = LEAST,
    top: int | None = TOP,
    covered_percent: int = COVERED_PERCENT,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to ``order`` words (all with ``top=None``).

    Words are lower-cased (A-Z only) and counted in pieces between marks and line ends. a is
    the phrase's number of occurrences, at least ``least``; of its cuts into a first part with l
    and a rest with r occurrences, the one with the lowest ``floor(SCALE * a * a / (l * r))`` counts, the
    earliest of equal ones. A phrase that a longer candidate contains with at least ``covered_percent`` of its
    occurrences goes. n is the number of words of the language. A null language counts as
    ``und``, a null text as empty; repeated rows count each time; texts without words and empty
    tables give nothing. Products are decimals of 38 digits, exact up to 10^15 occurrences.
    """
    counts = saved(phrase_counts(docs, order, least, text, lang), "phrases")
    parts = F.split("phrase", " ", -1)
    candidates = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "words", "a", cut).select(
        "lang", "phrase", "a", "k",
        _joined(parts, 1, F.col("k")).alias("left"), _joined(parts, F.col("k") + 1, F.col("words")).alias("right"),
    )
    halves = counts.where("words >= 1")
    cuts = cuts.join(halves.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(halves.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    longer = candidates.where("words > 2").select("lang", "words", "a", parts.alias("parts"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = longer.select("lang", "a", "parts", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    around = inner.groupBy("lang", _joined(F.col("parts"), F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (100 * F.col("around") < covered_percent * F.col("a"))
    )
    order_by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order_by))
    listed = ranked if top is None else ranked.where(F.col("rank") <= top)
    totals = small(saved(counts.where("words = 0").select("lang", F.col("f").alias("n")), "totals"))
    return listed.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )
