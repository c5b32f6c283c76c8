"""Keyword ranking by BM25, and its fusion with a ranking by vectors."""

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.operators.search import top_per_query
from shelfmark.schema import SEARCH_LIMIT, positive
from shelfmark.sources import storage
from shelfmark.sources.files import open_location

WORD = r"[\p{L}\p{N}_]+"
SATURATION = 1.2
LENGTH_WEIGHT = 0.75
RANK_OFFSET = 60
SCORE_DIGITS = 6
# Words and hits of the questions that a task holds; more of them are asked in several passes over the table.
PASS_ENTRIES = 2_000_000
# Pairs of a row's word and a question that asks for it that are added up together.
PAIRS = 1 << 20


def words_of(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def rarity(corpus: Row) -> Column:
    """The factor of a word that ``_rows`` rows hold."""
    return F.log1p((corpus["rows"] - F.col("_rows") + 0.5) / (F.col("_rows") + 0.5))


def term_share(corpus: Row) -> Column:
    """The factor of ``_count`` occurrences of a word in a row of ``_length`` words."""
    damped = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * F.col("_length") / corpus["length"])
    return F.col("_count") * (SATURATION + 1) / (F.col("_count") + damped)


def term_weight(corpus: Row) -> Column:
    """What these occurrences of a word add to a row's score."""
    return rarity(corpus) * term_share(corpus)


def _kept(rows: DataFrame, name: str, per_file: int = 0) -> tuple[str, DataFrame]:
    """Rows written to the shared folder, where every task can read them: the folder, and the rows in it."""
    spark = rows.sparkSession
    folder = storage.qualified(spark, f"{storage.shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    rows.write.option("maxRecordsPerFile", per_file).parquet(folder)
    storage.delete_at_exit(spark, folder)
    return folder, spark.read.schema(rows.schema).parquet(folder)


def _read(files: Sequence[str], columns: list[str]) -> pa.Table | None:
    parts = []
    for file in files:
        file_system, path = open_location(file)
        parts.append(dataset.dataset(path, filesystem=file_system, format="parquet").to_table(columns=columns))
    return pa.concat_tables(parts) if parts else None


class _Asked:
    """The words of the questions of a pass, in order, and for each word the questions that ask for it."""

    def __init__(self, files: Sequence[str]):
        found = _read(files, ["_query", "_terms"])
        if found is None:
            self.terms, self.numbers = pa.array([], pa.string()), np.empty(0, np.int64)
            self.starts, self.queries = np.zeros(1, np.int64), np.empty(0, np.int64)
            return
        lists = found["_terms"].combine_chunks()
        words = lists.flatten()
        distinct = words.unique()
        self.terms = distinct.take(pc.sort_indices(distinct))
        term = pc.index_in(words, value_set=self.terms).to_numpy()
        self.numbers = found["_query"].to_numpy()
        order = np.argsort(term, kind="stable")
        self.queries = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[order]
        self.starts = np.searchsorted(term[order], np.arange(len(self.terms) + 1))


def _bags(files: Sequence[str], keys: Sequence[str]):
    """Of each row the number of its words, and which words asked for it has, by their place, how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = _Asked(files).terms
        for batch in batches:
            words = batch.column("_words")
            lengths = pc.list_value_length(words)
            term = pc.index_in(words.flatten(), value_set=terms)
            known = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
            row = np.repeat(np.arange(len(words)), lengths.to_numpy(zero_copy_only=False))[known]
            term = term.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64)
            pairs, counts = np.unique(row * max(len(terms), 1) + term, return_counts=True)
            row, term = np.divmod(pairs, max(len(terms), 1))
            begins = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(begins, pa.array(v.astype(np.int32))) for v in (term, counts)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), lengths, *lists], [*keys, "_length", "_terms", "_counts"]
            )

    return run


class _Best:
    """The best hits per question that a task has met, ties by keys."""

    def __init__(self, questions: int, k: int, keys: Sequence[str]):
        self.k, self.keys = k, keys
        self.bound = np.full(questions, -np.inf)  # the score that k hits of a question reach
        self.held: pa.Table | None = None
        self.new: list[pa.Table] = []

    def add(self, query: np.ndarray, score: np.ndarray, keys: pa.Table) -> None:
        found = pa.table([pa.array(query), pa.array(-score), *keys.columns], ["_q", "_less", *(f"_key{i}" for i in range(len(self.keys)))])
        self.new.append(found)
        if sum(map(len, self.new)) >= (len(self.held) // 2 if self.held else 0):
            self.cut()

    def cut(self) -> None:
        if not self.new:
            return
        every = pa.concat_tables([*([self.held] if self.held else []), *self.new])
        self.new = []
        order = pc.sort_indices(every, sort_keys=[(c, "ascending") for c in every.column_names], null_placement="at_start").to_numpy()
        query = every["_q"].to_numpy()[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.held = every.take(pa.array(order[place < self.k])).combine_chunks()
        last = order[place == self.k - 1]
        self.bound[query[place == self.k - 1]] = -every["_less"].to_numpy()[last]


def _ranker(files: Sequence[str], rarities: str, length: float, k: int, keys: Sequence[str]):
    """A task's ``k`` best rows per question. Rows are ordered by keys first, so that equal scores are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(files)
        asked_by = np.diff(asked.starts)
        known = _read([rarities], ["_term", "_rarity"])
        rarity_of = np.zeros(len(asked.terms))
        rarity_of[known["_term"].to_numpy()] = known["_rarity"].to_numpy()
        best, questions = _Best(len(asked.numbers), k, keys), max(len(asked.numbers), 1)
        schema = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            schema = table.select(keys).schema
            ordered = [(c, "ascending") for c in keys]
            table = table.take(pc.sort_indices(table.select(keys), sort_keys=ordered, null_placement="at_start"))
            begins = np.concatenate([[0], np.cumsum(pc.list_value_length(table["_terms"]).to_numpy())]).astype(np.int64)
            term, count, size = (table[c].combine_chunks().flatten().to_numpy() for c in ("_terms", "_counts", "_lengths"))
            damped = SATURATION * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * size / length)
            weight = rarity_of[term] * (count * (SATURATION + 1) / (count + damped))
            many = asked_by[term]
            upto = np.concatenate([[0], np.cumsum(many)])[begins]
            first = 0
            while first < len(table):
                end = max(first + 1, int(np.searchsorted(upto, upto[first] + PAIRS, side="right")) - 1)
                here = slice(begins[first], begins[end])
                times, row = many[here], np.repeat(np.arange(end - first), np.diff(begins[first : end + 1]))
                entry = np.repeat(np.arange(len(times)), times)
                inside = np.arange(len(entry)) - np.repeat(np.cumsum(times) - times, times)
                query = asked.queries[asked.starts[term[here]][entry] + inside]
                pair = row[entry] * questions + query
                # A sum for every row and question, or for those that meet only, where these are few.
                pairs = None
                if (end - first) * questions > 8 * len(pair):
                    pairs, pair = np.unique(pair, return_inverse=True)
                sums = np.bincount(pair, weight[here][entry])
                if pairs is None:
                    pairs = np.flatnonzero(sums)
                    sums = sums[pairs]
                score = np.floor(sums * 10**SCORE_DIGITS + 0.5) / 10**SCORE_DIGITS
                row, query = np.divmod(pairs, questions)
                near = np.flatnonzero(score >= best.bound[query])
                near = near[np.lexsort((row[near], -score[near], query[near]))]
                place = np.arange(len(near)) - np.searchsorted(query[near], query[near])
                near = near[place < k]
                if len(near):
                    best.add(query[near], score[near], table.select(keys).take(pa.array(row[near] + first)))
                first = end
        best.cut()
        if best.held:
            columns = [asked.numbers[best.held["_q"].to_numpy()], -best.held["_less"].to_numpy()]
            found = pa.table([*columns, *best.held.columns[2:]], ["_query", "keyword_score", *keys])
            yield from found.cast(pa.schema([*found.schema][:2] + [*schema])).to_batches(max_chunksize=65_536)

    return run


def _passes(asked: DataFrame, k: int) -> list[list[str]]:
    """The files of questions in groups of so many words and hits, or of one file."""
    weight = F.sum(F.size("_terms") + F.lit(k)).alias("weight")
    groups, held = [[]], 0
    for row in asked.groupBy(F.col("_metadata.file_path").alias("file")).agg(weight).orderBy("file").collect():
        if groups[-1] and held + row["weight"] > PASS_ENTRIES:
            groups.append([])
            held = 0
        groups[-1].append(row["file"])
        held += row["weight"]
    return groups


def _merged(bags: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with words asked for: keys, ``_terms``, ``_counts`` and the ``_lengths`` they are of; rows with the same keys are one.

    Only rows whose keys repeat are shuffled with their words.
    """
    bags = bags.where(F.size("_terms") > 0)
    single = bags.select(*keys, "_terms", "_counts", F.array_repeat("_length", F.size("_terms")).alias("_lengths"))
    repeated = bags.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = _kept(repeated.select(*(F.col(c).alias(f"_same{i}") for i, c in enumerate(keys))), "repeated-keys")[1]
    if repeated.isEmpty():
        return single

    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & F.col(c).eqNullSafe(F.col(f"_same{i}"))
    entries = bags.join(repeated, same, "left_semi").select(*keys, "_length", F.explode(F.arrays_zip("_terms", "_counts")).alias("_e"))
    entries = entries.groupBy(*keys, "_length", F.col("_e._terms").alias("_term")).agg(F.sum("_e._counts").cast("int").alias("_count"))
    whole = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_term", "_count", "_length"))).alias("_es"))
    whole = whole.select(*keys, F.col("_es._term").alias("_terms"), F.col("_es._count").alias("_counts"), F.col("_es._length").alias("_lengths"))
    return single.join(repeated, same, "left_anti").unionAll(whole)


def keyword_ranks(
    table: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    text_col: str = "content",
    keys: Sequence[str] = ("id", "chunk_index"),
) -> DataFrame:
    """The ``k`` best rows per query: ``query_id``, the keys, ``keyword_score``, ``rank`` (from 1).

    ``keys`` identify a row of ``table``; ``queries`` has ``query_id, query_text``. A row without
    a word of the query is no hit; null text has no words. Scores are rounded before they are
    ranked, so that equal rows tie, and ties follow the keys.

    When this is called, the questions' words and each row's counts of them are written to the
    shared folder; they are removed when the session ends. Tasks read the questions and add up the
    scores of their share of the rows: a row and its words are not shuffled (unless its keys
    repeat), and no row per pair of a question and a row is made, only a task's ``k`` best. More
    questions than a task holds are asked in several passes. For many questions with common words,
    :class:`keyword_index.KeywordIndex` gives the same rows for less.
    """
    k, keys = positive("k", k, SEARCH_LIMIT), list(keys)
    terms = F.array_distinct(words_of("query_text"))
    asked = queries.groupBy("query_id").agg(F.flatten(F.collect_list(terms)).alias("_terms")).where(F.size("_terms") > 0)
    # Numbers are fixed by being written here.
    asked = asked.withColumn("_query", F.monotonically_increasing_id())
    asked = _kept(asked, "asked-words", max(1, PASS_ENTRIES // (4 * k)))[1]
    rows = table.select(*keys, words_of(text_col).alias("_words"))
    key_fields = [T.StructField(c, table.schema[c].dataType) for c in keys]
    ints = T.ArrayType(T.IntegerType())
    bag = [T.StructField("_length", T.IntegerType()), T.StructField("_terms", ints), T.StructField("_counts", ints)]
    hit = [T.StructField("_query", T.LongType()), T.StructField("keyword_score", T.DoubleType()), *key_fields]
    candidates = None
    for files in _passes(asked, k):
        bags = _kept(rows.mapInArrow(_bags(files, keys), T.StructType([*key_fields, *bag])), "word-counts")[1]
        corpus = bags.agg(F.count(F.lit(1)).alias("rows"), F.avg("_length").alias("length")).first()
        merged = _merged(bags, keys)
        found_in = merged.select(F.explode("_terms").alias("_term")).groupBy("_term").agg(F.count(F.lit(1)).alias("_rows"))
        rarities = _kept(found_in.select("_term", rarity(corpus).alias("_rarity")), "rarities")[0]
        found = merged.mapInArrow(_ranker(files, rarities, corpus["length"], k, keys), T.StructType(hit))
        candidates = found if candidates is None else candidates.unionAll(found)
    scored = candidates.join(asked.select("query_id", "_query"), "_query").select("query_id", *keys, "keyword_score")
    return top_per_query(scored, k, [F.col("keyword_score").desc(), *(F.col(c) for c in keys)])


def fused(
    by_vector: DataFrame,
    by_keyword: DataFrame,
    k: int | None = None,
    keys: Sequence[str] = ("id", "chunk_index"),
) -> DataFrame:
    """Reciprocal rank fusion of two rankings (``query_id``, the keys, ``rank``).

    Gives ``query_id``, the keys, ``vector_rank``, ``keyword_rank`` (null where a ranking
    does not have the row), ``score`` and ``rank``; ties follow the keys.
    """
    k = positive("k", k, SEARCH_LIMIT)
    on = ["query_id", *keys]
    left = by_vector.select(*on, F.col("rank").alias("vector_rank"))
    right = by_keyword.select(*on, F.col("rank").alias("keyword_rank"))

    def part(rank: str):
        return F.coalesce(F.lit(1.0) / (RANK_OFFSET + F.col(rank)), F.lit(0.0))

    both = left.join(right, on, "full").withColumn("score", part("vector_rank") + part("keyword_rank"))
    return top_per_query(both, k, [F.col("score").desc(), *(F.col(c) for c in keys)])
