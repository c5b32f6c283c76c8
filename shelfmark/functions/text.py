"""Column expressions over text and raw bytes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.schema import (
    BUDGET_SHARE,
    CHARS_PER_TOKEN,
    CONTEXT_TOKENS,
    TRUNCATE_ABOVE_SHARE,
)

# Code points a Unicode-aware strip removes.
WHITESPACE = "".join(
    map(
        chr,
        [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680]
        + list(range(0x2000, 0x200B))
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Task prefixes some embedding models expect.
QUERY_PREFIX = "search_query: "
DOCUMENT_PREFIX = "search_document: "

SNIFF_BYTES = 1024
UTF8_MARK = "\ufeff"

# Byte-order marks, longest first, and what a character but NUL is in bytes read as Latin-1.
_LOW, _HIGH = "[\\xDC-\\xDF]", "[\\xD8-\\xDB]"
_MARKED = {
    "UTF-32BE": (b"\0\0\xfe\xff", r"(?s)\x00(?!\x00[\xD8-\xDF]|\x00\x00\x00)[\x00-\x10].."),
    "UTF-32LE": (b"\xff\xfe\0\0", r"(?s)(?!.[\xD8-\xDF]\x00|\x00\x00\x00)..[\x00-\x10]\x00"),
    "UTF-16BE": (b"\xfe\xff", f"(?s)(?!\\x00\\x00)[^\\xD8-\\xDF].|{_HIGH}.{_LOW}."),
    "UTF-16LE": (b"\xff\xfe", f"(?s)(?!\\x00\\x00).[^\\xD8-\\xDF]|.{_HIGH}.{_LOW}"),
}


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _marked(content: Column) -> dict[str, tuple[Column, Column]]:
    """Per encoding with a mark of its own: whether it applies, and the bytes after the mark as Latin-1.

    It applies to bytes that begin with the mark and are well-formed to their end, without a NUL character.
    """
    found = {}
    for name, (mark, character) in _MARKED.items():
        # Matches follow one another, so what is left over begins where a character is broken.
        body = F.decode(F.substring(content, len(mark) + 1, 2**31 - 1), "ISO-8859-1")
        begins = F.substring(content, 1, len(mark)) == F.lit(bytearray(mark))
        found[name] = (begins & (F.regexp_replace(body, character, "") == ""), body)
    return found


def decoded(content: Column) -> Column:
    """Bytes to text: UTF-16 and UTF-32 behind their marks, UTF-8 when valid, else Latin-1 (which always is).

    Newlines become ``\\n``. A mark at the beginning is no part of the text. Bytes with a mark of UTF-16 or UTF-32 that
    are not well-formed, or hold a NUL character, are read like those without.
    """
    utf8 = F.try_validate_utf8(content.cast("string"))
    unmarked = F.when(F.startswith(utf8, F.lit(UTF8_MARK)), F.substring(utf8, 2, 2**31 - 1)).otherwise(utf8)
    text = F.coalesce(unmarked, F.decode(content, "ISO-8859-1"))
    for name, (applies, body) in reversed(_marked(content).items()):
        if name == "UTF-32LE":  # Spark knows the other order only
            body = F.regexp_replace(body, "(?s)(.)(.)(.)(.)", "$4$3$2$1")
        text = F.when(applies, F.decode(F.encode(body, "ISO-8859-1"), name.replace("32BE", "32").replace("32LE", "32"))).otherwise(text)
    return unix_newlines(text)


def head_is_binary(content: Column, assume_latin1: bool = True) -> Column:
    """Judge bytes by their first KiB: a NUL means binary, valid UTF-8 means text.

    The cut may split a character, so up to three bytes at its end are forgiven.
    Other NUL-free bytes are Latin-1 text, or binary without ``assume_latin1``.
    Bytes that ``decoded`` reads by a mark of UTF-16 or UTF-32 are text.
    """
    head = F.substring(content, 1, SNIFF_BYTES)
    binary = F.coalesce(F.position(F.lit(bytearray(b"\0")), head) > 0, F.lit(True))
    if not assume_latin1:
        size = F.octet_length(head)
        lengths = [size] + [
            F.when(F.octet_length(content) > SNIFF_BYTES, size - cut).otherwise(size)
            for cut in (1, 2, 3)
        ]
        valid = [F.is_valid_utf8(F.substring(head, F.lit(1), n).cast("string")) for n in lengths]
        binary = binary | ~(valid[0] | valid[1] | valid[2] | valid[3])
    for applies, _ in _marked(content).values():
        binary = F.when(applies, F.lit(False)).otherwise(binary)
    return binary


def chunk_budget(max_tokens: int) -> int:
    """Characters a chunk may hold for a token budget."""
    return int(max_tokens * CHARS_PER_TOKEN * BUDGET_SHARE)


def estimated_tokens(text: Column) -> Column:
    return F.length(text) / F.lit(CHARS_PER_TOKEN)


def truncated_to_context(text: Column, context_tokens: int = CONTEXT_TOKENS) -> Column:
    """Cut text that would fill more than the allowed share of a model's context."""
    limit = chunk_budget(context_tokens)
    too_long = estimated_tokens(text) > F.lit(context_tokens * TRUNCATE_ABOVE_SHARE)
    return F.when(too_long, F.substring(text, 1, limit)).otherwise(text)


def with_prefix(text: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(prefix), text) if prefix else text
