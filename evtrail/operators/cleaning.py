"""Projection, filtering and cleaning (B).  Pure DataFrame -> DataFrame."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evtrail.functions.dates import DEFAULT_TS_FORMATS, iso_date_or_raw, parse_timestamp_multi, parse_yyyymmdd
from evtrail.functions.text import NULL_TOKENS, null_tokens_to_null


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_strings(df: DataFrame, cols: Sequence[str] | None = None, tokens=NULL_TOKENS) -> DataFrame:
    """B1: trim and map null tokens ('', 'nan', 'None', ...) to null."""
    cols = set(cols if cols is not None else string_columns(df))
    return df.select(*[null_tokens_to_null(c, tokens).alias(c) if c in cols else F.col(c) for c in df.columns])


def parse_dates(df: DataFrame, cols: Sequence[str], formats=DEFAULT_TS_FORMATS) -> DataFrame:
    """B2: multi-format parse, bad -> null, timestamps naive UTC."""
    return df.withColumns({c: parse_timestamp_multi(c, formats) for c in cols})


def parse_compact_dates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``yyyyMMdd`` -> date."""
    return df.withColumns({c: parse_yyyymmdd(c) for c in cols})


def standardise_dates(df: DataFrame, cols: Sequence[str], formats=DEFAULT_TS_FORMATS) -> DataFrame:
    """ISO text or the original when unparseable, plus an invalid flag."""
    out = {}
    for c in cols:
        out[c] = iso_date_or_raw(c, formats)
        out[f"{c}_invalid"] = (F.col(c).isNotNull() & parse_timestamp_multi(c, formats).isNull()).cast("int")
    return df.withColumns(out)


def coerce_numeric(df: DataFrame, cols: Sequence[str], fill: float | None = None,
                   dtype: str = "double") -> DataFrame:
    """``try_cast`` (bad -> null, or ``fill``)."""
    def conv(c):
        v = F.col(c).cast("string").try_cast(dtype)
        return v if fill is None else F.coalesce(v, F.lit(fill).cast(dtype))
    return df.withColumns({c: conv(c) for c in cols})


def clip(c, lo=None, hi=None) -> Column:
    """Clip / floor."""
    x = F.col(c) if isinstance(c, str) else c
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """B7."""
    return df.dropna(subset=list(keys))


def drop_all_null_rows(df: DataFrame) -> DataFrame:
    """B8."""
    return df.dropna(how="all")


def all_null_columns(df: DataFrame) -> list[str]:
    """B9 (metadata): one aggregate pass counts non-nulls of every column;
    the 1-row result names the columns to drop."""
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] == 0]


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """B9."""
    return df.drop(*all_null_columns(df))


def non_null_counts(df: DataFrame) -> DataFrame:
    """B9 as data: (column, non_null) rows from one pass (stack of counts)."""
    agg = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    return agg.unpivot([], list(df.columns), "column_name", "non_null")


def dedup_exact(df: DataFrame) -> DataFrame:
    """Exact duplicate rows removed."""
    return df.dropDuplicates()


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key in an explicit order.

    Implemented as ``min(struct(order..., row))`` -- an aggregate with a
    map-side partial combine, so one hot key never goes to a single task
    whole (a ``row_number`` window would)."""
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                      F.struct(*others).alias("_row"))
    return (df.groupBy(*keys).agg(F.min(packed).alias("_m"))
            .select(*keys, *[F.col(f"_m._row.{c}").alias(c) for c in others]).select(*df.columns))


def lower_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Case-fold categoricals."""
    return df.withColumns({c: F.lower(F.col(c)) for c in cols})


def fill_sentinels(df: DataFrame, fills: Mapping[str, object]) -> DataFrame:
    """Constant / sentinel fill (0, 'Unknown', '__MISSING__', 9999)."""
    return df.fillna(dict(fills))


def conform(df: DataFrame, expected: Sequence[tuple[str, str]]) -> DataFrame:
    """Add missing expected columns as typed nulls, then order by the
    expected list (extra columns dropped)."""
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in expected])


def fahrenheit_to_celsius(c, threshold: float = 45.0) -> Column:
    """Numeric coercion then °F->°C when the value exceeds ``threshold``."""
    x = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when(x > threshold, (x - 32) * 5.0 / 9.0).otherwise(x)


def flag_to_int(c, true_values: Iterable[str] = ("1", "Y")) -> Column:
    """Type-tagged flag mapping -> 0/1 (null stays null)."""
    x = F.upper(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")))
    return F.when(x.isNull(), F.lit(None).cast("int")).otherwise(x.isin(list(true_values)).cast("int"))


def rename_select(df: DataFrame, mapping: Mapping[str, str], drop: Sequence[str] = ()) -> DataFrame:
    """Rename by mapping, drop metadata columns."""
    return df.drop(*drop).withColumnsRenamed(dict(mapping))


def predicate(col: str, op: str, value=None) -> Column:
    """Declarative predicates (pushed to the scan by Catalyst)."""
    c = F.col(col)
    ops = {
        "eq": lambda: c == value, "ne": lambda: c != value, "lt": lambda: c < value, "le": lambda: c <= value,
        "gt": lambda: c > value, "ge": lambda: c >= value, "in": lambda: c.isin(list(value)),
        "between": lambda: c.between(value[0], value[1]), "contains": lambda: c.contains(value),
        "like": lambda: c.like(value), "ilike": lambda: c.ilike(value),
        "is_null": lambda: c.isNull(), "not_null": lambda: c.isNotNull(),
    }
    return ops[op]()
