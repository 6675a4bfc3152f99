"""Scalar rules whose semantics change results, each under its own name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go towards plus infinity, as Math.round does; Spark's round goes away from zero."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def safe_ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, or `empty` where b is zero."""
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def percent(a: Column, b: Column) -> Column:
    """Percentage to one decimal, 0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.floor(a * 1000.0 / b + 0.5) / 10)


def to_number(text: Column) -> Column:
    """Empty, garbage and NaN are 0."""
    x = F.trim(text).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def finite(x: Column) -> Column:
    """NaN and infinities are null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def rank_of(value: Column, order: list[str]) -> Column:
    """Position of a closed set's member (0 first), null for others."""
    return F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, k)])[value]


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds names the reason; null if none does."""
    out = None
    for holds, reason in rules:
        out = F.when(holds, reason) if out is None else out.when(holds, reason)
    return out


def unit_number(text: Column) -> Column:
    """Numbers with units: infinity is null, % is a hundredth, KB and MB are bytes, commas go."""
    clean = F.regexp_replace(F.trim(text), ",", "")
    n = F.regexp_extract(clean, r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return (
        F.when(clean.contains("∞"), F.lit(None))
        .when(clean.endswith("%"), n / 100)
        .when(clean.rlike(r"(?i)kb$"), n * 1024)
        .when(clean.rlike(r"(?i)mb$"), n * 1048576)
        .otherwise(n)
    )


def gzip_length(text: str) -> Column:
    """Bytes of a text's UTF-8 as gzip at the usual level, without a file name or time; null for null."""
    import zlib

    def one(t):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: with the header and trailer of gzip
        return None if t is None else len(c.compress(t.encode())) + len(c.flush())

    return F.pandas_udf(lambda texts: texts.map(one).astype("Int64"), "bigint", F.PandasUDFType.SCALAR)(text)


def in_locale(text: Column, locale: str = "en") -> Column:
    """Text that compares, sorts, groups and joins as a locale has it, not by bytes."""
    return F.collate(text, locale)
