"""Band names: `INDEX_YYYY_MM`, possibly with something before and after."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDICES = ("NDVI", "EVI", "CIre", "NDWI")


def band_pattern(indices: Sequence[str] = INDICES) -> str:
    return f"({'|'.join(re.escape(i) for i in indices)})_([0-9]{{4}})_([0-9]{{2}})"


def parse_band(name: Column, indices: Sequence[str] = INDICES) -> list[Column]:
    """Columns index, year and month; null where the name has no such part."""
    part = lambda k: F.nullif(F.regexp_extract(name, band_pattern(indices), k), F.lit(""))
    return [part(1).alias("index"), part(2).cast("int").alias("year"), part(3).cast("int").alias("month")]


def band_name(index: Column, year: Column, month: Column) -> Column:
    return F.format_string("%s_%d_%02d", index, year, month)


def band_or_number(description: Column, number: Column) -> Column:
    """The description, or `band_<number>` where it is null or empty."""
    return F.coalesce(F.nullif(description, F.lit("")), F.concat(F.lit("band_"), number.cast("string")))


def year_columns(names: Sequence[str], year: int, indices: Sequence[str] = INDICES) -> dict[int, str]:
    """Place of each parsable band and its column for the year that is being
    processed.  Raises if there is none, or if two bands get one column."""
    out = {}
    for k, name in enumerate(names):
        if m := re.search(band_pattern(indices), name or ""):
            out[k] = f"{m[1]}_{year}_{m[3]}"
    if not out:
        raise ValueError(f"no band of {len(names)} has a name like INDEX_YYYY_MM")
    twice = {c for c in out.values() if list(out.values()).count(c) > 1}
    if twice:
        raise ValueError(f"several bands for {', '.join(sorted(twice))}")
    return out


def columns_of(df: DataFrame, prefix: str = "NDVI_") -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix))
