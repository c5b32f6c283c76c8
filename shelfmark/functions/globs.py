"""Ignore patterns as Column predicates.

Patterns follow the rules of git ignore files. Each is turned once, on the
driver, into one anchored regular expression over the corpus-relative path, so
that matching is a plain ``rlike`` on the cluster.
"""

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns left out of every index.
DEFAULT_EXCLUDES = [
    "*.pyc",
    "__pycache__",
    ".git",
    ".gitignore",
    "node_modules",
    "*.log",
    "*.tmp",
    "*.lock",
    ".env",
    ".env.*",
    "venv",
    ".venv",
    "env",
    ".idea",
    ".vscode",
    "*.egg-info",
    "dist",
    "build",
    ".pytest_cache",
    ".tox",
    "*.db",
    "*.sqlite",
    "*.sqlite3",
]

_TOKEN = re.compile(r"\\(?P<quoted>.)|(?P<cls>\[[!^]?\]?[^\]]*\])|(?P<star>\*+)|(?P<any>\?)|(?P<char>.)", re.S)


def _segment_regex(segment: str) -> str:
    """Regex of one path segment; wildcards stay inside it."""
    if set(segment) == {"*"}:
        return "[^/]+"
    out = []
    for token in _TOKEN.finditer(segment):
        if token["star"]:
            out.append("[^/]*")
        elif token["any"]:
            out.append("[^/]")
        elif token["cls"]:
            body = token["cls"][1:-1].replace("\\", r"\\").replace("[", r"\[")
            negated = body[:1] in ("!", "^")
            body = body[1:] if negated else body
            if body.startswith("]"):
                body = r"\]" + body[1:]
            out.append(f"[^/{body}]" if negated else f"[{body}]")
        else:
            char = token["quoted"] or token["char"]
            out.append(char if char.isalnum() or char == "_" or char == "/" else "\\" + char)
    return "".join(out)


def glob_to_regex(pattern: str) -> str:
    """Anchored regex for one pattern without its leading ``!``."""
    only_below = pattern.endswith("/")
    body = pattern.rstrip("/")
    anchored = "/" in body
    segments = [s for s in body.split("/") if s]
    if not segments:
        return r"^$"
    parts = ["^"] if anchored else ["^(?:.+/)?"]
    for position, segment in enumerate(segments):
        last = position == len(segments) - 1
        if segment == "**":
            parts.append(".+" if last else "(?:.+/)?")
        else:
            parts.append(_segment_regex(segment) + ("" if last else "/"))
    if only_below:
        parts.append("/.*$")
    elif segments[-1] == "**":
        parts.append("$")
    else:
        parts.append("(?:/.*)?$")
    return "".join(parts)


def clean_patterns(lines: Iterable[str]) -> list[str]:
    """Strip lines, drop blanks and comments."""
    stripped = (line.strip() for line in lines)
    return [line for line in stripped if line and not line.startswith("#")]


def split_patterns(text: str | None) -> list[str]:
    """Comma-separated patterns, as given on a command line."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """True when the patterns, read in order, end up matching: the last rule that applies wins."""
    rules = [(p[1:], False) if p.startswith("!") else (p, True) for p in patterns]
    rules = [(glob_to_regex(p), wanted) for p, wanted in rules if p]
    if not rules:
        return F.lit(False)
    if all(wanted for _, wanted in rules):
        return path.rlike("|".join(regex for regex, _ in rules))
    # Signed position of the last rule that applies; rules of equal sign next to
    # each other share one regex.
    runs: list[tuple[list[str], bool]] = []
    for regex, wanted in rules:
        if runs and runs[-1][1] == wanted:
            runs[-1][0].append(regex)
        else:
            runs.append(([regex], wanted))
    decision = F.lit(False)
    for regexes, wanted in runs:
        decision = F.when(path.rlike("|".join(regexes)), F.lit(wanted)).otherwise(decision)
    return decision


def pruning_regex(*rule_sets: Iterable[str]) -> str | None:
    """Regex of folders, with a slash at their end, below which every file is excluded.

    A set in which a ``!`` rule could bring a file back prunes nothing, nor does a
    pattern with a character class.
    """
    sets = [list(rules) for rules in rule_sets]
    sure = [p for s in sets if not any(p.startswith("!") for p in s) for p in s if p and "[" not in p]
    return "|".join(glob_to_regex(p) for p in sure) or None


def exclusion_reason(
    path: Column,
    ignore_patterns: Iterable[str] = (),
    extra_patterns: Iterable[str] = (),
    default_patterns: Iterable[str] = DEFAULT_EXCLUDES,
) -> Column:
    """``gitignore``, ``default`` or ``additional``, whichever applies first; null keeps the path.

    The three sets are independent: a ``!`` rule in one cannot bring back what
    another excludes.
    """
    return (
        F.when(matches_any(path, ignore_patterns), F.lit("gitignore"))
        .when(matches_any(path, default_patterns), F.lit("default"))
        .when(matches_any(path, extra_patterns), F.lit("additional"))
    )
