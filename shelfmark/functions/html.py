"""Column expressions over web pages."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a reader never sees; an element that is never closed reaches to the end.
_UNSEEN = [
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
]
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_END = "\x01"
# The five basic entities; the ampersand last, so that nothing is unescaped twice.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _split(text: Column, use: Callable[[Column, Column], Column]) -> Column:
    """``use`` of the text up to its last ``>``, where every tag that begins also ends, and of what follows it."""

    def halves(whole: Column, tail: Column) -> Column:
        return use(F.substring(whole, F.lit(1), F.length(whole) - F.length(tail)), tail)

    return _once(text, lambda whole: _once(F.substring_index(whole, ">", -1), lambda tail: halves(whole, tail)))


def _without_elements(text: Column, pattern: str) -> Column:
    """Elements as spaces. The pattern never looks for the end of a tag in vain, which would take quadratic time.

    Behind the last ``>`` nothing begins or ends; it goes if an open element reaches it, and so the end mark before it.
    """

    def joined(shown: Column, tail: Column) -> Column:
        whole = F.substring(shown, F.lit(1), F.length(shown) - 1)
        return F.when(F.endswith(shown, F.lit(_END)), F.concat(whole, tail)).otherwise(shown)

    def cleared(head: Column, tail: Column) -> Column:
        return _once(F.regexp_replace(F.concat(head, F.lit(_END)), pattern, " "), lambda shown: joined(shown, tail))

    return _split(text, cleared)


def page_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags become spaces, entities characters.

    Runs of spaces and tabs become one space and lines lose them at both ends; null stays null.
    Takes time linear in the page, whatever it leaves open.
    """
    text = html
    for pattern in _UNSEEN:
        text = _without_elements(text, pattern)
    text = F.regexp_replace(text, _COMMENT, " ")
    text = _split(text, lambda head, tail: F.concat(F.regexp_replace(head, "<[^>]*>", " "), tail))
    for entity, character in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(text, "[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, "\n ", "\n"), " \n", "\n")


def host(url: Column) -> Column:
    """Host of a URL without port, empty where there is none."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
