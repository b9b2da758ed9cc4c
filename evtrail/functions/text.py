"""String expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that means "missing" in landed string columns.
NULL_TOKENS = ("", "nan", "None", "NaN", "null", "NULL")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens_to_null(c, tokens=NULL_TOKENS) -> Column:
    t = F.trim(_c(c))
    return F.when(t.isin(list(tokens)), F.lit(None).cast("string")).otherwise(t)


def clean_text(c) -> Column:
    return null_tokens_to_null(c)


def word_tokens(c, pattern: str = "[a-z0-9_]+") -> Column:
    """Lower-case then extract all regex matches -> array<string>."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(f"({pattern})"), 1)


def normalize_header(name: str) -> str:
    """Column-name normalisation: lower, non ``[a-z0-9_]`` -> ``_``, collapse
    repeats, strip leading/trailing ``_``.  Runs on the driver over column
    names only (metadata, not data)."""
    s = re.sub(r"[^a-z0-9_]", "_", name.strip().lower())
    s = re.sub(r"_+", "_", s)
    return s.strip("_")


def text_hash(c, seed: int = 0) -> Column:
    """Seeded hash that every engine has: the first 32 bits of the MD5 of
    ``seed:value`` as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string"))), 1, 8), 16, 10).cast("long")
