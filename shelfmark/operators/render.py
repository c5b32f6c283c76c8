"""Turn the hits of each query into one text.

A query has at most ``k`` hits, so the group behind one text is bounded.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.display import location_label, percent_text, preview, score_text

# The texts around the hits.
NO_RESULTS = "No results found."
FOUND = "Found %d relevant files:\n"
HUMAN_RULE = "\n" + "=" * 60 + "\n"
HUMAN_HIT_END = "\n" + "-" * 60 + "\n"

STYLES = ("human", "machine")


def _label() -> Column:
    return location_label(
        *(F.col(c) for c in ("file_path", "start_line", "end_line", "chunk_index", "total_chunks"))
    )


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def _human_text(hits: Column) -> Column:
    def listed(hit: Column, index: Column) -> Column:
        return _lines(
            F.concat((index + 1).cast("string"), F.lit(". "), hit["label"]),
            F.concat(
                F.lit("   Similarity: "),
                hit["score"],
                F.lit(" | Size: "),
                hit["size_bytes"].cast("string"),
                F.lit(" bytes"),
            ),
        )

    def shown(hit: Column, index: Column) -> Column:
        return _lines(
            F.concat(F.lit("## "), (index + 1).cast("string"), F.lit(". "), hit["label"], F.lit("\n")),
            hit["body"],
            F.lit(HUMAN_HIT_END),
        )

    return _lines(
        F.format_string(FOUND, F.size(hits)),
        F.array_join(F.transform(hits, listed), "\n"),
        F.lit(HUMAN_RULE),
        F.array_join(F.transform(hits, shown), "\n"),
    )


def _machine_text(hits: Column) -> Column:
    def shown(hit: Column, index: Column) -> Column:
        return _lines(
            F.concat(F.lit("\n## "), (index + 1).cast("string"), F.lit(". "), hit["label"]),
            F.concat(
                F.lit("**Relevance:** "), hit["percent"], F.lit(" | **Type:** "), hit["extension"]
            ),
            F.lit("\n```"),
            hit["body"],
            F.lit("```\n"),
        )

    return _lines(
        F.format_string(FOUND, F.size(hits)), F.array_join(F.transform(hits, shown), "\n")
    )


def render(
    hits: DataFrame,
    queries: DataFrame | None = None,
    style: str = "human",
    max_content_length: int | None = None,
) -> DataFrame:
    """``query_id, text``: one text per query that has hits, or per row of ``queries``.

    Hits are numbered by their place in rank order, so filters that left gaps in
    the ranks leave none in the text.
    """
    if style not in STYLES:
        raise ValueError(f"style must be human or machine, got {style!r}")
    per_hit = hits.select(
        "query_id",
        F.struct(
            "rank",
            _label().alias("label"),
            score_text(F.col("similarity")).alias("score"),
            percent_text(F.col("similarity")).alias("percent"),
            F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
            F.coalesce("extension", F.lit("")).alias("extension"),
            F.coalesce(preview(F.col("content"), max_content_length), F.lit("")).alias("body"),
        ).alias("hit"),
    )
    grouped = per_hit.groupBy("query_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    build = _human_text if style == "human" else _machine_text
    texts = grouped.select("query_id", build(F.col("hits")).alias("text"))
    if queries is None:
        return texts
    return (
        queries.select("query_id")
        .join(texts, "query_id", "left")
        .select("query_id", F.coalesce("text", F.lit(NO_RESULTS)).alias("text"))
    )
