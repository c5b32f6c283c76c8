"""Language identification by compression with one raw-content dictionary per language."""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import fold, saved, small, texts

#: Distinct labelled texts per language that a dictionary is built from, chosen by their hash.
SAMPLE_TEXTS = 256
#: Bytes of a dictionary; each sampled text gives an equal share from a place that its hash picks.
DICTIONARY_BYTES = 64 * 1024
#: A text is compressed in blocks of this many bytes, so that all of it meets the dictionary, not the text before it.
BLOCK_BYTES = 2048
LEVEL = 3
#: Share of the size by which the best dictionary must win; below it the prediction is marked as rejected.
NARROW = 0.01

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def train(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """The dictionaries, from text and lang of the rows outside the held-out fold; rows without lang or letters do not count.

    Spark keeps the sample_texts distinct texts with the smallest hashes per language: a
    third of all rows being copies of one text still is one text. Only those reach the driver.
    Every language keeps its whole sample; a smaller one is repeated up to the size of the largest.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    rows = rows.where("lang is not null and text is not null and doc_id is not null").where(fold(F.col("doc_id")) != 1)
    keyed = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("text").alias("key"), "doc_id")
    distinct = keyed.groupBy("lang", "key").agg(F.min("doc_id").alias("doc_id"))
    first = Window.partitionBy("lang").orderBy("key")
    chosen = saved(
        distinct.withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample_texts).select("lang", "key", "doc_id"), "sample"
    )
    share = dictionary_bytes // sample_texts
    length = F.length("text")
    begin = F.when(length > share, F.pmod(F.xxhash64("key"), length - share + 1)).otherwise(F.lit(0)).cast("int")
    found = (
        rows.join(small(chosen.select("lang", "key", "doc_id")), ["lang", "doc_id"])
        .where(F.xxhash64("text") == F.col("key"))
        .select("lang", "key", F.substring(F.col("text"), begin + 1, F.lit(share)).alias("part"))
        .distinct()
        .orderBy("lang", "key", "part")
        .toArrow()
    )
    parts: dict[str, list[str]] = {}
    for lang, part in zip(found.column("lang").to_pylist(), found.column("part").to_pylist(), strict=True):
        parts.setdefault(lang, []).append(part)
    joined = {lang: " ".join(p).encode("utf-8", "replace") + b" " for lang, p in parts.items()}
    room = max(64, *map(len, joined.values())) if joined else 0  # equal sizes by repetition, so that the size favours no language
    return {lang: (data * -(-room // len(data)))[-room:] for lang, data in sorted(joined.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = [
            zstandard.ZstdCompressor(
                level=LEVEL,
                dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_checksum=False,
                write_content_size=False,
                write_dict_id=False,
            )
            for data in dictionaries.values()
        ]

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text under each dictionary, block by block."""
        data = text.encode("utf-8", "replace")
        blocks = [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(coder.compress(block)) for block in blocks) for coder in self.coders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected): the smallest size wins, the earlier name among equals.

        The score is the softmax of the sizes' differences, in nats a block of text at
        most; (und, 0, True) if there is no letter or nothing was learned.
        """
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = int(np.argmin(sizes))
        scale = max(1.0, len(text) / 256)
        score = 1.0 / sum(math.exp(-min(50.0, (s - sizes[best]) / scale)) for s in sizes)
        rest = sorted(sizes)[1] if len(sizes) > 1 else sizes[0] * 2
        return self.langs[best], score, (rest - sizes[best]) < NARROW * sizes[best]


def predicted(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, rejected of each row's whole text; rows stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                rows = [classifier.predict(text) for text in part.column(1).to_pylist()]
                langs, scores, rejected = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs.

    Texts that are null or have no letters are ``und`` with score 0; so are all texts if
    nothing could be learned. Repeated rows give repeated results; ties go to the name that sorts first.
    A narrow win keeps its language and is marked as rejected.
    """
    return predicted(docs, train(docs)).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")
