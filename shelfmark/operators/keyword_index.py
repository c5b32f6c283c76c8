"""A stored keyword index: postings in blocks by falling weight, so that a search reads the best of a word only.

An index is a folder of four tables. ``members`` has the keys of each row and the id of its text; ``bags`` has the words
of each distinct text; ``words`` has how many rows hold a word; ``postings`` has the texts of a word with their weights,
heaviest first, in blocks. ``totals`` is written last: a folder without it is no index.
"""

import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.hybrid import SCORE_DIGITS, rarity, term_share, term_weight, words_of
from shelfmark.operators.search import top_per_query
from shelfmark.schema import SEARCH_LIMIT, positive
from shelfmark.sources import storage

BLOCK = 128
# A word's postings are dealt to lists of about so many, each ordered for itself, so no task sorts a common word's alone.
LIST = 100_000
# Scores are rounded before they are ranked, so what is this close to a bound may still tie.
_SLACK = 1.01 * 10.0**-SCORE_DIGITS


def _text_hash(text: Column) -> Column:
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("_term", T.StringType()), T.StructField("_count", T.IntegerType())])))
def _bag_of(words: pa.Array) -> pa.Array:
    """The distinct words of each row's list, and how often each is in it."""
    flat = pc.dictionary_encode(words.flatten())
    distinct = max(len(flat.dictionary), 1)
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    code = flat.indices.to_numpy(zero_copy_only=False)
    pairs, counts = np.unique(row * distinct + code, return_counts=True)
    row, code = np.divmod(pairs, distinct)
    begins = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
    entries = [flat.dictionary.take(pa.array(code)), pa.array(counts.astype(np.int32))]
    return pa.ListArray.from_arrays(begins, pa.StructArray.from_arrays(entries, ["_term", "_count"]))


class KeywordIndex:
    """BM25 over a table as it was when the index was built; the same hits as :func:`hybrid.keyword_ranks`."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")
        if not storage.exists(spark, f"{self.location}/totals/_SUCCESS"):
            raise ValueError(f"no complete keyword index in {location}")
        self.totals = self._table("totals").first()
        self.keys = [c for c in self._table("members").columns if c != "_hash"]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.location}/{name}")

    @classmethod
    def build(
        cls, table: DataFrame, location: str, text_col: str = "content", keys: Sequence[str] = ("id", "chunk_index")
    ) -> "KeywordIndex":
        """Write the index of ``table`` into a new folder.

        Equal texts are indexed once. Null text has no words, but its row counts. Repeated keys are rows of their own.
        """
        spark, location = table.sparkSession, location.rstrip("/")
        if storage.exists(spark, location):
            raise ValueError(f"{location} exists")

        def written(name: str, rows: DataFrame) -> DataFrame:
            rows.write.parquet(f"{location}/{name}")
            return spark.read.schema(rows.schema).parquet(f"{location}/{name}")

        text = F.coalesce(F.col(text_col), F.lit(""))
        written("members", table.select(*keys, _text_hash(text).alias("_hash")))
        texts = (
            table.select(F.struct(*keys).alias("_first"), text.alias("_text"), _text_hash(text).alias("_hash"))
            .groupBy("_hash")
            .agg(F.min("_first").alias("_first"), F.count(F.lit(1)).alias("_copies"), F.first("_text").alias("_text"))
            .select("_hash", "_first", "_copies", words_of(F.col("_text")).alias("_words"))
        )
        # Words are counted in the row, so no task holds the words of many texts.
        bags = texts.select("_hash", "_first", "_copies", _bag_of("_words").alias("_bag"))
        length = F.aggregate("_bag", F.lit(0), lambda total, e: total + e["_count"]).alias("_length")
        bags = bags.select("_hash", "_first", "_copies", length, "_bag")
        # Numbers are short in postings; they are fixed by being written here.
        bags = written("bags", bags.withColumn("_text", F.monotonically_increasing_id()))

        totals = bags.agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.col("_copies") * F.col("_length")) / F.sum("_copies"), F.lit(0.0)).alias("length"),
        )
        corpus = totals.first()
        words = written(
            "words",
            bags.select("_copies", F.inline("_bag"))
            .groupBy("_term")
            .agg(F.sum("_copies").alias("_rows"), F.count(F.lit(1)).alias("_texts")),
        )
        # Only words of more than one list need to say so; the others are in list 0 without a join of all words.
        common = words.where(F.col("_texts") > LIST).select("_term", F.ceil(F.col("_texts") / LIST).alias("_lists"))
        found = bags.select("_text", "_length", F.inline("_bag")).join(common, "_term", "left")
        list_of = F.coalesce(F.pmod(F.xxhash64("_text"), F.col("_lists")), F.lit(0)).cast("int").alias("_list")
        posting = F.struct((-term_share(corpus)).alias("_share"), "_text", "_count", "_length")
        dealt = found.select("_term", list_of, posting.alias("_posting"))
        lists = dealt.groupBy("_term", "_list").agg(F.sort_array(F.collect_list("_posting")).alias("_postings"))
        begins = F.sequence(F.lit(1), F.size("_postings"), F.lit(BLOCK))
        blocks = F.transform(begins, lambda begin: F.slice("_postings", begin, BLOCK))
        blocks = lists.select("_term", "_list", F.posexplode(blocks).alias("_block", "_entries")).select(
            "_term",
            "_list",
            "_block",
            (-F.col("_entries")[0]["_share"]).alias("_share"),
            F.transform("_entries", lambda e: F.struct(e["_text"], e["_count"], e["_length"])).alias("_entries"),
        )
        written("postings", blocks)
        totals.coalesce(1).write.parquet(f"{location}/totals")
        return cls(spark, location)

    def _kept(self, rows: DataFrame) -> DataFrame:
        """Rows written down, as what follows reads them more than once."""
        folder = f"{storage.shared_folder(self.spark)}/keywords-{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        storage.delete_at_exit(self.spark, folder)
        return self.spark.read.schema(rows.schema).parquet(folder)

    def _bounds(self, queries: DataFrame, k: int) -> DataFrame:
        """``query_id, _term, _rows, _cut, _open``: a text none of whose words weighs ``_cut`` is no hit.

        The texts in the best blocks of a query's words give a score that ``k`` texts reach. Words that cannot reach it
        together, the lightest first, are not looked up; the others share what those leave of it. ``_open`` is the most
        that a word may add to a text it was not looked up for.
        """
        asked = queries.select("query_id", F.explode(F.array_distinct(words_of(F.col("query_text")))).alias("_term"))
        # Written first, so that Spark knows their size when it decides what to send where.
        asked = self._kept(asked.distinct())
        asked = self._kept(self._table("words").select("_term", "_rows").join(asked, "_term"))
        terms = asked.select("_term", "_rows").distinct()
        # Blocks are ranked by their heads; only those that win are read.
        best = (rarity(self.totals) * F.col("_share")).alias("_best")
        of_block = ["_term", "_list", "_block"]
        blocks = self._table("postings").select(*of_block, "_share").join(terms, "_term").select(*of_block, "_rows", best)
        by_best = Window.partitionBy("_term").orderBy(F.col("_best").desc(), "_list", "_block")
        heads = blocks.withColumn("_place", F.row_number().over(by_best)).where(F.col("_place") <= -(-k // BLOCK))
        heads = self._kept(heads)
        entries = self._table("postings").drop("_share").join(heads.select(*of_block, "_rows"), of_block)
        entries = self._kept(entries.select("_term", "_rows", F.inline("_entries")))
        seen = entries.select("_term", "_text", term_weight(self.totals).alias("_weight")).join(asked, "_term")
        reached = top_per_query(
            seen.groupBy("query_id", "_text").agg(F.sum("_weight").alias("_sum")), k, [F.col("_sum").desc(), F.col("_text")]
        ).where(F.col("rank") == k).select("query_id", (F.col("_sum") - _SLACK).alias("_reached"))
        most = heads.where("_place = 1").select("_term", "_best")
        rising = Window.partitionBy("query_id").orderBy("_best", "_term")
        whole = Window.partitionBy("query_id")
        light = F.col("_upto") < F.col("_reached")
        left = F.col("_reached") - F.max(F.when(light, F.col("_upto")).otherwise(0.0)).over(whole)
        return (
            asked.join(most, "_term")
            .join(reached, "query_id", "left")
            .fillna(0.0, ["_reached"])
            .withColumn("_upto", F.sum("_best").over(rising.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("_share", left / F.greatest(F.count_if(~light).over(whole), F.lit(1)))
            .withColumn("_cut", F.when(light, F.lit(float("inf"))).otherwise(F.col("_share")))
            .select("query_id", "_term", "_rows", "_cut", F.least("_cut", "_best").alias("_open"))
        )

    def _looked_up(self, bounds: DataFrame) -> DataFrame:
        """``query_id, _text, _sum, _seen``: the weights of a text at or above the cuts, and what of the open is closed."""
        wanted = bounds.where(F.col("_cut") < float("inf"))
        reaches = rarity(self.totals) * F.col("_share") >= F.col("_cut")
        met = self._table("postings").join(wanted, "_term").where(reaches)
        entries = met.select("query_id", "_rows", "_cut", "_open", F.inline("_entries"))
        entries = entries.withColumn("_weight", term_weight(self.totals)).where(F.col("_weight") >= F.col("_cut"))
        return entries.groupBy("query_id", "_text").agg(F.sum("_weight").alias("_sum"), F.sum("_open").alias("_seen"))

    def _candidates(self, bounds: DataFrame, k: int) -> DataFrame:
        """``query_id, _text`` of all texts that may be among the ``k`` best."""
        partial = self._kept(self._looked_up(bounds))
        order = [F.col("_sum").desc(), F.col("_text")]
        reached = top_per_query(partial, k, order).where(F.col("rank") == k).select("query_id", F.col("_sum").alias("_reached"))
        opened = bounds.groupBy("query_id").agg(F.sum("_open").alias("_open"))
        possible = F.col("_sum") + F.col("_open") - F.col("_seen")
        return (
            partial.join(opened, "query_id")
            .join(reached, "query_id", "left")
            .where(F.col("_reached").isNull() | (possible >= F.col("_reached") - _SLACK))
            .select("query_id", "_text")
        )

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """The ``k`` best rows per query: ``query_id``, the keys, ``keyword_score``, ``rank`` (from 1).

        ``queries`` has ``query_id, query_text``. Exact: bounds leave out only what cannot be a hit. Ties follow the
        keys. Of a text that very many rows share, ``k`` rows are looked at.
        """
        k = positive("k", k, SEARCH_LIMIT)
        bounds = self._kept(self._bounds(queries, k))
        candidates = self._kept(self._candidates(bounds, k))
        bags = self._table("bags").join(candidates.select("_text").distinct(), "_text", "left_semi")
        words = bags.select("_text", "_hash", "_first", "_length", F.inline("_bag"))
        asked = candidates.join(bounds.select("query_id", "_term", "_rows"), "query_id")
        scored = (
            words.join(asked, ["_text", "_term"])
            .withColumn("_weight", term_weight(self.totals))
            .groupBy("query_id", "_hash", "_first")
            .agg(F.round(F.sum("_weight"), SCORE_DIGITS).alias("keyword_score"))
        )
        # A text before another in this order has a row before all rows of the other.
        best = top_per_query(scored, k, [F.col("keyword_score").desc(), F.col("_first")])
        best = self._kept(best.select("query_id", "_hash", "keyword_score"))
        members = self._table("members").join(best.select("_hash").distinct(), "_hash", "left_semi")
        first = Window.partitionBy("_hash").orderBy(*self.keys)
        members = members.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k).drop("_place")
        rows = best.join(members, "_hash").select("query_id", *self.keys, "keyword_score")
        return top_per_query(rows, k, [F.col("keyword_score").desc(), *(F.col(c) for c in self.keys)])
