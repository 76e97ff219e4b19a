"""File identity, extensions and content types as Columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: they must equal the reference's for equal results -------------------------------------------------

DEFAULT_EXTENSIONS = (".txt", ".log", ".json", ".csv", ".xml", ".html", ".md")

CONTENT_TYPES = {
    ".txt": "text/plain",
    ".log": "text/plain",
    ".json": "application/json",
    ".xml": "application/xml",
    ".html": "text/html",
    ".csv": "text/csv",
    ".md": "text/markdown",
    ".yaml": "application/x-yaml",
    ".yml": "application/x-yaml",
    ".conf": "text/plain",
    ".cfg": "text/plain",
    ".ini": "text/plain",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"

# ---------------------------------------------------------------------------------------------------------------------


def local_path(uri: Column) -> Column:
    """The path without the ``file:`` scheme Spark puts before local ones; other schemes stay."""
    return F.regexp_replace(uri, "^file:/+", "/")


def decoded_path(uri: Column) -> Column:
    """``local_path`` of the percent-encoded URI that ``_metadata.file_path`` holds."""
    return local_path(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def file_id(path: Column) -> Column:
    """A stable id of the path: it does not depend on content or run."""
    return F.sha2(path, 256)


def extension(path: Column) -> Column:
    """The last dot of the last path element and what follows, lower-cased; empty without a dot."""
    return F.lower(F.regexp_extract(path, "\\.[^./]*$", 0))


def has_extension(path: Column, extensions: Iterable[str] = DEFAULT_EXTENSIONS) -> Column:
    """Whether the extension is in the set; an empty set admits every file."""
    wanted = sorted({e.lower() for e in extensions})
    return extension(path).isin(*wanted) if wanted else F.lit(True)


def content_type(path: Column) -> Column:
    """Content type by exact (case-sensitive) suffix; the path must be longer than the suffix."""
    suffix = F.regexp_extract(path, "(?s)^.+(\\.[a-z]+)$", 1)
    known = F.create_map(*(F.lit(part) for item in CONTENT_TYPES.items() for part in item))
    return F.coalesce(F.try_element_at(known, suffix), F.lit(DEFAULT_CONTENT_TYPE))


def rfc3339(when: Column) -> Column:
    return F.date_format(when, "yyyy-MM-dd'T'HH:mm:ssXXX")
