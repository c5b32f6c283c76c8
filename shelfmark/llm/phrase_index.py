"""Benchmark decontamination by a positional inverted index of the training words; DataFrame functions only."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import saved, small

WINDOW_WORDS = 10
#: Terms of a window whose postings are intersected before texts are compared.
PROBES = 2
#: Item windows, items or candidate documents (two numbers each, or one item's words) that a broadcast may hold.
BROADCAST_TERMS = 200_000
#: Bytes of words or ids that a broadcast may hold.
BROADCAST_BYTES = 32 * 1024 * 1024

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """ASCII letters (lowered), digits and all other characters beyond ASCII, in runs; none for null."""
    lowered = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _SEPARATORS, -1), "")


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, content_key and text: two rows that share a number but not a text stay apart."""
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text).cast("string")).alias("content_key"),
        F.col(text).cast("string").alias("text"),
    )


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The index: one row (term, doc_id, content_key, position) for each word of each document.

    ``terms`` (a column ``term``, distinct) restricts it to those words; no row is shuffled for that
    if they can be broadcast. Write it partitioned or bucketed by term to keep it.
    """
    rows = docs.select("doc_id", "content_key", F.posexplode(words(F.col("text"))).alias("position", "term"))
    return rows if terms is None else rows.join(terms, "term")


def term_counts(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term, n: how often each word (each of ``terms``, if given) occurs in all documents; counted on the map side first."""
    rows = docs.select(F.explode(words(F.col("text"))).alias("term"))
    rows = rows if terms is None else rows.join(terms, "term")
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW_WORDS) -> DataFrame:
    """item_id, first (position) and terms of each window of ``size`` words; a shorter item is one window.

    Repeated items count once, items that share an id stay apart; items without words have no window.
    Equal windows of an item are one, at the first place.
    """
    split = items.select(
        F.col(item_id).cast("string").alias("item_id"), words(F.col(text).cast("string")).alias("terms")
    ).where(F.size("terms") > 0)
    first = F.explode(F.sequence(F.lit(0), F.greatest(F.size("terms") - size, F.lit(0)))).alias("first")
    cut = split.select("item_id", F.xxhash64("item_id", "terms").alias("item_key"), first, "terms").select(
        "item_id", "item_key", "first", F.slice("terms", F.col("first") + 1, size).alias("terms")
    )
    return cut.groupBy("item_id", "item_key", "terms").agg(F.min("first").alias("first")).select("item_id", "item_key", "first", "terms")


def _small_texts(frame: DataFrame, texts: Column) -> DataFrame:
    """The (saved) frame with a broadcast hint if rows and the bytes of ``texts`` are both few."""
    rows, size = frame.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(texts)), F.lit(0))).head()
    return F.broadcast(frame) if rows <= BROADCAST_TERMS and size <= BROADCAST_BYTES else frame


def phrase_hits(docs: DataFrame, windows: DataFrame, probes: int = PROBES) -> DataFrame:
    """Exact occurrences: rows (doc_id, content_key, item_id, start, stop) in word positions, stop exclusive.

    Every window picks its ``probes`` rarest terms by their counts in the documents. Their
    postings, moved back by the term's place in its item, meet where document and item run
    in step: (document, item, shift). Shifts where all probes of a window meet are then
    compared word by word with the document, so only a few documents are read again.
    Windows share probes with their neighbours, so a place in an item is probed once.
    """
    numbered = saved(windows, "windows")
    place = numbered.select("item_key", "first", F.posexplode("terms").alias("offset", "term"))
    vocabulary = _small_texts(saved(place.select("term").distinct(), "terms"), F.col("term"))
    known = saved(term_counts(docs, vocabulary), "counts")
    rarity = Window.partitionBy("item_key", "first").orderBy(F.coalesce("n", F.lit(0)), "offset")
    probe = saved(
        place.join(known, "term", "left")
        .withColumn("rank", F.row_number().over(rarity))
        .where(F.col("rank") <= probes)
        .select("item_key", "first", "term", (F.col("first") + F.col("offset")).alias("at")),
        "probes",
    )
    places = saved(probe.select("item_key", "term", "at").distinct(), "places")
    found = (
        postings(docs, _small_texts(places, F.col("term")))
        .groupBy("doc_id", "content_key", "item_key", (F.col("position") - F.col("at")).alias("shift"))
        .agg(F.collect_set("at").alias("ats"))
    )
    # Most shifts have fewer terms in step than any window of the item asks for; only the others are looked at by window.
    needed = probe.groupBy("item_key", "first").agg(F.count(F.lit(1)).alias("needed"))
    fewest = small(saved(needed.groupBy("item_key").agg(F.min("needed").alias("fewest")), "needed"), BROADCAST_TERMS)
    in_step = found.join(fewest, "item_key").where(F.size("ats") >= F.col("fewest"))
    by_place = small(saved(probe.select("item_key", "first", "at").join(needed, ["item_key", "first"]), "places"), BROADCAST_TERMS)
    candidates = saved(
        in_step.select("doc_id", "content_key", "item_key", "shift", F.explode("ats").alias("at"))
        .join(by_place, ["item_key", "at"])
        .groupBy("doc_id", "content_key", "item_key", "shift", "first", "needed")
        .agg(F.count(F.lit(1)).alias("met"))
        .where("met = needed"),
        "candidates",
    )
    terms = _small_texts(numbered.select("item_id", "item_key", "first", "terms"), F.array_join("terms", ""))
    claims = candidates.join(terms, ["item_key", "first"]).select(
        "doc_id", "content_key", "item_id", (F.col("shift") + F.col("first")).alias("start"), "terms"
    ).where("start >= 0")
    wanted = saved(
        claims.groupBy("doc_id", "content_key").agg(F.collect_set(F.struct("item_id", "start", "terms")).alias("claims")), "claims"
    )
    wanted = wanted.withColumnsRenamed({"doc_id": "id_", "content_key": "key_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("content_key") == F.col("key_"))
    # The numbers of the few documents with claims filter the others out before any text is shuffled.
    split = docs.join(small(wanted.select("id_", "key_")), same, "left_semi").join(wanted, same).select("doc_id", "content_key", "claims", words(F.col("text")).alias("words"))
    # Word by word: a slice in a lambda would copy the whole text for each claim.
    other = lambda c: F.transform(c["terms"], lambda t, i: F.coalesce(F.get("words", c["start"] + i) != t, F.lit(True)))
    true = F.filter("claims", lambda c: ~F.exists(other(c), lambda differs: differs))
    return (
        split.select("doc_id", "content_key", F.explode(true).alias("hit"))
        .select("doc_id", "content_key", "hit.item_id", "hit.start", (F.col("hit.start") + F.size("hit.terms")).alias("stop"))
        .distinct()
    )


def proximity_hits(docs: DataFrame, items: DataFrame, span: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, content_key, item_id, near): an occurrence of the item's rarest word with all its other words, in any order, less than ``span`` words away."""
    term = items.select(F.col(item_id).cast("string").alias("item_id"), F.explode(F.array_distinct(words(F.col(text)))).alias("term"))
    term = saved(term.distinct(), "terms")
    index = saved(postings(docs, small(term.select("term").distinct(), BROADCAST_TERMS)), "index")
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("item_id").orderBy(F.coalesce("n", F.lit(0)), "term")
    ranked = saved(
        term.join(counts, "term", "left")
        .withColumn("rank", F.row_number().over(by_count))
        .withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("item_id"))),
        "ranked",
    )
    rarest = index.join(ranked.where("rank = 1"), "term").select("doc_id", "content_key", "item_id", "terms", F.col("position").alias("near"))
    others = index.join(ranked.where("rank > 1").select("term", "item_id"), "term").select(
        "doc_id", "content_key", "item_id", F.col("term").alias("other"), "position"
    )
    key = ["doc_id", "content_key", "item_id"]
    together = (
        rarest.join(others, key)
        .where(F.abs(F.col("position") - F.col("near")) < span)
        .groupBy(*key, "near", "terms")
        .agg(F.countDistinct("other").alias("met"))
        .where("met = terms - 1")
    )
    alone = rarest.where("terms = 1")
    return together.select(*key, "near").union(alone.select(*key, "near"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs``.

    A word inside any occurrence of an item's window is hit; items count once by id. Null
    and empty texts have no words. Repeated rows give repeated results; a null item_id is
    searched and hits, but no id is listed for it. Tables may be empty.
    """
    rows = _documents(docs, doc_id, text)
    hits = phrase_hits(rows, item_windows(items, size=size))
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence("start", F.col("stop") - 1))))).cast("long")
    per_document = _small_texts(
        saved(
            hits.groupBy("doc_id", "content_key").agg(
                covered.alias("hit"), F.sort_array(F.collect_set("item_id")).alias("items")
            ),
            "hits",
        ),
        F.array_join("items", ","),
    )
    per_document = per_document.withColumnsRenamed({"doc_id": "id_", "content_key": "key_"})
    no_items = F.array().cast("array<string>")
    return rows.select("doc_id", "content_key", F.size(words(F.col("text"))).cast("long").alias("n_words")).join(
        per_document, F.col("doc_id").eqNullSafe(F.col("id_")) & F.col("content_key").eqNullSafe(F.col("key_")), "left"
    ).select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", no_items)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", no_items), ","), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )
