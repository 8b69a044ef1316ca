"""Text column expressions (all JVM-side, inside whole-stage codegen).

Python's ``str.strip``/``\\w``/``\\s`` are Unicode-aware; Java's plain ``\\s`` and ``\\w`` are
ASCII-only and ``trim`` strips spaces only, so the classes are spelled out with Unicode
properties. The same patterns run unchanged in DuckDB (RE2), which the oracle relies on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that reproduce Python's Unicode rules.
# White space as Python's str.isspace / str.strip sees it.
WS_CLASS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
# A "word" character as Python's \w sees it (letters, numbers, underscore).
WORD_CLASS = r"\p{L}\p{N}_"
# Token separator of the default embedder and topic extractor.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"

NOT_BLANK_RE = f"[^{WS_CLASS}]"
STRIP_RE = f"^[{WS_CLASS}]+|[{WS_CLASS}]+$"
NON_NAME_RE = f"[^{WORD_CLASS}]"
NON_WORD_OR_SPACE_RE = f"[^{WORD_CLASS}{WS_CLASS}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c) -> Column:
    """True when the text holds something other than white space (Python: ``s.strip() != ''``)."""
    return col_(c).rlike(NOT_BLANK_RE)


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode white space at both ends."""
    return F.regexp_replace(col_(c), STRIP_RE, "")


def collection_name(c) -> Column:
    """File name -> collection name: every char that is not a word char becomes ``_``.

    Equals the two-step rule (non word/dot -> ``_``, then dots -> ``_``).
    """
    return F.regexp_replace(col_(c), NON_NAME_RE, "_")


def normalize_text(c) -> Column:
    """Drop chars that are neither word nor space, lower-case, strip."""
    return py_strip(F.lower(F.regexp_replace(col_(c), NON_WORD_OR_SPACE_RE, "")))


def tokens(c) -> Column:
    """Lower-cased letter/number runs; empty pieces dropped."""
    return F.filter(F.split(F.lower(col_(c)), TOKEN_SPLIT, -1), lambda t: t != "")


def has_extension(c, ext: str) -> Column:
    return F.endswith(F.lower(col_(c)), F.lit(ext.lower()))
