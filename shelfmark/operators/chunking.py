"""Split text into line-tracked chunks under a character budget.

Everything happens inside the row: no shuffle, no Python worker. One regular
expression reads the text from chunk to chunk, and line numbers follow from the
newlines each chunk holds.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import chunk_budget, strip
from shelfmark.schema import CONTEXT_TOKENS, positive

# The regular-expression engine goes one level deeper at each change between one-unit
# and two-unit characters in a repetition, up to the budget. So two-unit ones (emoji and
# other supplementary characters) are stood in for, and texts read in pieces of so many characters.
_PIECE = 1024
_SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"

# Lines and lengths are summed up in slices of so many chunks, as a fold that grows one array copies it each time.
_FOLD = 256

CHUNK_FIELDS = ("content", "start_line", "end_line", "chunk_index", "total_chunks")


def _chunk_pattern(budget: int) -> str:
    """Pattern whose successive matches are the chunks of a text that ends in a newline.

    The first alternative that applies is taken:

    * at the beginning of a line, as many whole lines as fit;
    * inside a line too long for a chunk, its rest, if that fits;
    * a part of such a line up to its last space, if that lies in the later half;
    * a part as long as the budget.

    Every match is at most ``budget`` characters long and is found in time linear
    in that, so a text takes time linear in its length.
    """
    most, late = budget - 1, budget // 2 + 1
    whole_lines = rf"(?<![^\n])(?s:.{{0,{most}}})\n"
    rest_of_line = rf"[^\n]{{0,{most}}}\n"
    up_to_space = rf"[^\n]{{{late},{most}}} "
    full_length = rf"[^\n]{{{budget}}}"
    parts = [whole_lines, rest_of_line, *([up_to_space] if late <= most else []), full_length]
    return "|".join(parts)


def _budget(max_tokens: int) -> int:
    budget = chunk_budget(positive("max_tokens", max_tokens, CONTEXT_TOKENS))
    if budget < 1:
        raise ValueError(f"max_tokens={max_tokens} leaves no room for a character")
    return budget


def _matches(text: Column, budget: int) -> Column:
    return F.regexp_extract_all(
        F.concat(text, F.lit("\n")), F.lit(_chunk_pattern(budget)), F.lit(0)
    )


def _stand_in(text: Column) -> Column:
    """The text with a letter for each supplementary character: the same length and cuts."""
    return F.regexp_replace(text, _SUPPLEMENTARY, "x")


def _cut_as(text: Column, parts: Column) -> Column:
    """The text cut into parts as long as the given ones.

    Each is put together from the pieces that it touches, as looking for a place from the text's start would take
    quadratic time.
    """
    sizes = F.transform(parts, F.length)
    pieces = F.regexp_extract_all(F.concat(text, F.lit("\n")), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))

    def part(known: Column, size: Column, index: Column) -> Column:
        begin = F.get(known["begins"], index)
        first, last = F.floor(begin / _PIECE), F.floor((begin + size - 1) / _PIECE)
        touched = F.array_join(F.slice(known["pieces"], (first + 1).cast("int"), (last - first + 1).cast("int")), "")
        return F.substring(touched, (begin % _PIECE + 1).cast("int"), size)

    # One entry through a transform, so that the inner one finds everything computed.
    known = F.struct(sizes.alias("sizes"), _running_sums(sizes, 0).alias("begins"), pieces.alias("pieces"))
    cut = F.transform(F.array(known), lambda k: F.transform(k["sizes"], lambda size, i: part(k, size, i)))
    return F.get(cut, 0)


def _parts(text: Column, budget: int) -> Column:
    """The chunks of a text beyond the budget, newlines and white space still on."""
    return F.when(
        text.rlike(_SUPPLEMENTARY), _cut_as(text, _matches(_stand_in(text), budget))
    ).otherwise(_matches(text, budget))


def chunk_count(text: Column, max_tokens: int | None = CONTEXT_TOKENS) -> Column:
    """How many chunks ``chunk_text`` makes of a text, without making them; null for null."""
    if max_tokens is None:
        return F.when(text.isNotNull(), F.lit(1))
    budget = _budget(max_tokens)
    return F.when(F.length(text) <= budget, F.lit(1)).when(
        text.isNotNull(), F.size(_matches(_stand_in(text), budget))
    )


def _newlines(part: Column) -> Column:
    return F.octet_length(part) - F.octet_length(F.replace(part, F.lit("\n"), F.lit("")))


def _whole_text_chunk(text: Column) -> Column:
    return F.array(
        F.struct(
            text.alias("content"),
            F.lit(1).alias("start_line"),
            F.size(F.split(text, "\n", -1)).alias("end_line"),
            F.lit(1).alias("total_chunks"),
        )
    )


def _first_lines(parts: Column) -> Column:
    """Line each part begins in: one more than the newlines before it."""
    return _running_sums(F.transform(parts, _newlines), 1)


def _running_sums(counts: Column, first: int) -> Column:
    """``first`` and the sums of it and all counts up to each."""
    begins = F.sequence(F.lit(1), F.greatest(F.size(counts), F.lit(1)), F.lit(_FOLD))
    slices = F.transform(begins, lambda begin: F.slice(counts, begin, _FOLD))

    def running(first: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.array(first),
            lambda lines, count: F.array_append(lines, F.element_at(lines, -1) + count),
        )

    def step(state: Column, part: Column) -> Column:
        # One entry through a transform, so that the inner fold is computed once.
        made = F.transform(F.array(running(state["line"], part)), lambda lines: F.struct(
            F.element_at(lines, -1).alias("line"),
            F.array_append(state["lists"], F.slice(lines, 1, F.size(lines) - 1)).alias("lists"),
        ))
        return F.get(made, 0)

    start = F.struct(F.lit(first).alias("line"), F.array().cast("array<array<int>>").alias("lists"))
    return F.aggregate(
        slices,
        start,
        step,
        lambda state: F.array_append(F.flatten(state["lists"]), state["line"]),
    )


def _split_chunks(parts: Column, lines: Column) -> Column:
    def chunk(part: Column, index: Column) -> Column:
        first, following = F.get(lines, index), F.get(lines, index + 1)
        return F.struct(
            strip(part).alias("content"),
            first.alias("start_line"),
            F.greatest(first, following - 1).alias("end_line"),
            F.size(parts).alias("total_chunks"),
        )

    return F.transform(parts, chunk)


def chunk_text(
    df: DataFrame,
    text_col: str = "content",
    max_tokens: int | None = CONTEXT_TOKENS,
    drop_empty: bool = False,
) -> DataFrame:
    """One row per chunk: the other columns of ``df`` and the five chunk columns.

    ``max_tokens=None`` keeps each text whole. A text within the budget is kept
    as it is; chunks of a split text are stripped and may be empty. Rows whose
    text is null give nothing. ``drop_empty`` leaves out empty chunks, and keeps
    the numbering of the others.
    """
    others = [c for c in df.columns if c not in (text_col, *CHUNK_FIELDS)]
    text = F.col("_text")
    rows = df.where(F.col(text_col).isNotNull()).select(*others, F.col(text_col).alias("_text"))
    if max_tokens is None:
        rows = rows.select(*others, _whole_text_chunk(text).alias("_chunks"))
    else:
        budget = _budget(max_tokens)
        fits = F.length(text) <= budget
        rows = rows.withColumn("_parts", F.when(~fits, _parts(text, budget)))
        rows = rows.withColumn("_lines", _first_lines(F.col("_parts")))
        rows = rows.select(
            *others,
            F.when(fits, _whole_text_chunk(text))
            .otherwise(_split_chunks(F.col("_parts"), F.col("_lines")))
            .alias("_chunks"),
        )
    # The outer form stops the optimizer from adding a filter on the array, which
    # would compute it twice; a non-null text always has a chunk. Nothing but the
    # chunk is read above the explode, so the array is not copied to every row.
    rows = rows.select(*others, F.posexplode_outer("_chunks").alias("chunk_index", "_chunk"))
    chunks = rows.select(
        *others,
        *(F.col("_chunk")[name].alias(name) for name in ("content", "start_line", "end_line")),
        "chunk_index",
        F.col("_chunk")["total_chunks"].alias("total_chunks"),
    )
    return chunks.where(F.col("content") != "") if drop_empty else chunks
