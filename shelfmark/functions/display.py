"""Column expressions that turn a hit into text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text forms of a hit.
TRUNCATION_MARK = "\n... (truncated)"


def _or_default(value: Column, default: int) -> Column:
    """Null and zero both mean the default."""
    return F.coalesce(F.nullif(value, F.lit(0)), F.lit(default))


def location_label(
    file_path: Column,
    start_line: Column,
    end_line: Column,
    chunk_index: Column,
    total_chunks: Column,
) -> Column:
    """``path (lines a-b)``, with the chunk number when the file has several."""
    start, end = _or_default(start_line, 1), _or_default(end_line, 1)
    index, total = _or_default(chunk_index, 0), _or_default(total_chunks, 1)
    return F.when(
        total > 1,
        F.format_string("%s (lines %d-%d, chunk %d/%d)", file_path, start, end, index + 1, total),
    ).otherwise(F.format_string("%s (lines %d-%d)", file_path, start, end))


def preview(content: Column, max_length: int | None) -> Column:
    """Whole content, or its first ``max_length`` characters and a mark. None and 0: no cut."""
    if not max_length:
        return content
    return F.when(
        F.length(content) > max_length,
        F.concat(F.substring(content, 1, max_length), F.lit(TRUNCATION_MARK)),
    ).otherwise(content)


def fixed_decimals(value: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value.

    ``format_number`` does that too, but for half a unit of the last digit itself,
    which it takes for an exact tie.
    """
    half_unit = 0.5 * 10**-digits
    return F.when(value == half_unit, F.lit(f"{half_unit:.{digits}f}")).otherwise(
        F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))
    )


def score_text(similarity: Column) -> Column:
    return fixed_decimals(similarity, 3)


def percent_text(similarity: Column) -> Column:
    return F.concat(fixed_decimals(similarity * 100, 2), F.lit("%"))
