"""Column expressions over file paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower-case extension -> language.
LANGUAGES = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".java": "java",
    ".c": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".cs": "csharp",
    ".go": "go",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".swift": "swift",
    ".kt": "kotlin",
    ".scala": "scala",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
    ".r": "r",
    ".R": "r",
    ".m": "matlab",
    ".sql": "sql",
    ".html": "html",
    ".htm": "html",
    ".css": "css",
    ".scss": "scss",
    ".sass": "sass",
    ".less": "less",
    ".xml": "xml",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".toml": "toml",
    ".ini": "ini",
    ".cfg": "ini",
    ".conf": "conf",
    ".md": "markdown",
    ".markdown": "markdown",
    ".rst": "restructuredtext",
    ".txt": "text",
    ".vue": "vue",
    ".svelte": "svelte",
}

# Extensions whose MIME type is text/*, and compression suffixes a
# MIME lookup by name sees through.
TEXT_EXTENSIONS = [
    "bat", "c", "css", "csv", "etx", "h", "htm", "html", "js", "ksh", "markdown", "md", "mjs",
    "n3", "pl", "py", "rst", "rtf", "rtx", "sgm", "sgml", "srt", "tsv", "txt", "vcf", "vtt", "xml",
]
COMPRESSION_SUFFIXES = ["gz", "Z", "bz2", "xz", "br"]


def extension(path: Column) -> Column:
    """Last dot and what follows, dot included; empty for dot files and bare names."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def extension_or_placeholder(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", F.lit("no_extension")).otherwise(ext)


def language(ext: Column) -> Column:
    """Language of an extension, looked up in lower case."""
    pairs = ", ".join(f"'{suffix}', '{name}'" for suffix, name in LANGUAGES.items())
    return F.coalesce(F.expr(f"map({pairs})")[F.lower(ext)], F.lit("unknown"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a path outside stays as it is."""
    prefix = root.rstrip("/") + "/"
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 2**31 - 1)
    ).otherwise(path)


def without_local_scheme(path: Column) -> Column:
    """``file:/a`` and ``file:///a`` become ``/a``; other schemes stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def modified_iso(ts: Column) -> Column:
    """ISO-8601 text without zone; microseconds are left out when they are zero."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, ".SSSSSS")
    return F.concat(seconds, F.when(micros == ".000000", F.lit("")).otherwise(micros))


def has_text_mime(path: Column) -> Column:
    """True when the name alone says text/*."""
    names = "|".join(TEXT_EXTENSIONS)
    packed = "|".join(COMPRESSION_SUFFIXES)
    return path.rlike(rf"(?:^|/)\.*[^/.][^/]*\.(?i:{names})(?:\.(?:{packed}))?$")
