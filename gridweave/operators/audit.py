"""Quality of a pixel table: sampling, missing values, distribution.

Medians are exact and made by ranks: values are counted, counts are summed in
RANGES equal ranges of value, and only the values of the ranges that hold the
middle ranks are put in order, so no task holds the values of a whole zone.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW, BINS, CHUNK = 0.3, 100, 500_000
#: Ranges of value in which a median is looked for.
RANGES = 4096
EDGES = [float(x) for x in np.linspace(-1, 1, BINS + 1)]


def spread(chunks: int, wanted: int = 5) -> list[int]:
    """Numbers of the sampled chunks, evenly spaced from the first to the last."""
    m = min(wanted, chunks)
    return [0] * (m > 0) if m < 2 else sorted({k * (chunks - 1) // (m - 1) for k in range(m)})


def sample_chunks(df: DataFrame, numbers: Sequence[int], chunk: int = CHUNK, key: str = "pixel_id") -> DataFrame:
    """Rows of these chunks, as ranges of the key, which reach the scan."""
    condition = F.lit(False)
    for k in numbers:
        condition = condition | F.col(key).between(k * chunk, (k + 1) * chunk - 1)
    return df.where(condition)


def missing_fraction(long: DataFrame, keys: Sequence[str] = ("zone", "pixel_id"), value: str = "value") -> DataFrame:
    """Share of each pixel's months that are null."""
    return long.groupBy(*keys).agg(F.avg(F.col(value).isNull().cast("int")).alias("missing"))


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """The median of the values that are not null, for each group; half of the sum of the two middle ones."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("total"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * RANGES), F.lit(RANGES - 1))).otherwise(0)
    ranged = counts.join(ends, by).withColumn("range", place)
    sums = ranged.groupBy(*by, "range").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    before = F.sum("m").over(Window.partitionBy(*by).orderBy("range")) - F.col("m")
    first, second = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = sums.withColumn("before", before).where((F.col("before") <= second) & (F.col("before") + F.col("m") > first)).select(*by, "range", "before")
    few = ranged.join(middle, [*by, "range"])
    up_to = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "range").orderBy("v"))
    at = lambda rank: F.max(F.when((F.col("up_to") > rank) & (F.col("up_to") - F.col("n") <= rank), F.col("v")))
    return few.withColumn("up_to", up_to).groupBy(*by).agg(((at(first) + at(second)) / 2).alias(name))


def missingness(fractions: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    others = fractions.groupBy(*by).agg(*(F.round(f("missing"), 6).alias(f"nan_fraction_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
    median = exact_median(fractions, by, "missing", "m")
    return others.join(median, list(by)).select(*by, "nan_fraction_mean", F.round("m", 6).alias("nan_fraction_median"), "nan_fraction_std")


def distribution(long: DataFrame, by: Sequence[str] = ("zone",), value: str = "value") -> DataFrame:
    others = long.where(F.col(value).isNotNull()).groupBy(*by).agg(*_moments(F.col(value).cast("double")))
    return _with_median(others, long, by, value)


def _moments(v: Column) -> list[Column]:
    return [
        F.count(v).alias("valid_value_count"),
        F.min(v).alias("valid_value_min"),
        F.max(v).alias("valid_value_max"),
        F.round(F.avg(v), 6).alias("valid_value_mean"),
        F.round(F.stddev_pop(v), 6).alias("valid_value_std"),
    ]


def _with_median(others: DataFrame, long: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    median = exact_median(long, by, value, "m")
    rest = [c for c in others.columns if c not in by and c != "valid_value_std"]
    at = rest.index("valid_value_mean") + 1
    return others.join(median, list(by), "left").select(*by, *rest[:at], F.round("m", 6).alias("valid_value_median"), "valid_value_std", *rest[at:])


def thresholds(long: DataFrame, by: Sequence[str] = ("zone",), low: float = LOW, value: str = "value") -> DataFrame:
    """Shares of the valid values below 0 and below `low`, compared as doubles."""
    return long.where(F.col(value).isNotNull()).groupBy(*by).agg(*_shares(F.col(value).cast("double"), low))


def _shares(v: Column, low: float) -> list[Column]:
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return [share(v < 0).alias("pct_negative"), share(v < low).alias("pct_below_low_threshold")]


def extent(df: DataFrame, by: Sequence[str] = ("zone",)) -> DataFrame:
    return df.groupBy(*by).agg(F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


def bin_number(value: Column) -> Column:
    """Number of the histogram bin on [-1, 1], null outside; corrected by the
    edges themselves, as arithmetic alone puts some values one bin too high."""
    v = value.cast("double")
    edges = F.array(*[F.lit(x) for x in EDGES])
    i = F.least(F.floor((v + 1) / 2 * BINS), F.lit(BINS - 1)).cast("int")
    return F.when(v.between(-1, 1), F.when(v < F.get(edges, i), i - 1).when((i < BINS - 1) & (v >= F.get(edges, i + 1)), i + 1).otherwise(i))


def histogram(long: DataFrame, value: str = "value") -> DataFrame:
    """bin, low, high and n of every bin, empty ones included."""
    counts = long.select(bin_number(F.col(value)).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = long.sparkSession.createDataFrame([(k, EDGES[k], EDGES[k + 1]) for k in range(BINS)], "bin int, low double, high double")
    return bins.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def summary(long: DataFrame, low: float = LOW, by: Sequence[str] = ("zone",)) -> DataFrame:
    """One row for each zone: missing values, distribution and thresholds.
    A zone without valid values has nulls.  Counts, moments and shares are one
    aggregation, a row for each pixel another, and the medians are made by ranks."""
    keys = [*by, "pixel_id"]
    v = F.col("value").cast("double")
    others = long.where(F.col("value").isNotNull()).groupBy(*by).agg(*_moments(v), *_shares(v, low))
    return missingness(missing_fraction(long, keys), by).join(_with_median(others, long, by, "value"), list(by), "left").withColumn("ndvi_low_threshold_used", F.lit(low))


def comparison(summaries: DataFrame, totals: DataFrame, low: float = LOW) -> DataFrame:
    """One row of formatted strings for each zone."""
    pct = lambda c: F.format_string("%.2f%%", F.col(c) * 100)
    return summaries.join(totals, "zone").select(
        F.upper("zone").alias("zone"),
        F.format_number("total_pixels", 0).alias("total_pixels"),
        pct("nan_fraction_mean").alias("nan_frac_mean"),
        pct("nan_fraction_median").alias("nan_frac_median"),
        F.format_string("[%.3f, %.3f]", "valid_value_min", "valid_value_max").alias("valid_range"),
        F.format_string("%.3f", "valid_value_mean").alias("valid_mean"),
        pct("pct_negative").alias("pct_negative"),
        pct("pct_below_low_threshold").alias("pct_below_low"),
    )


def sampled(wide: DataFrame, zone: str, total: int, chunk: int = CHUNK, n_chunks: int = 5, prefix: str = "NDVI_") -> tuple[DataFrame, list[str], list[int]]:
    """Rows of evenly spread chunks of a wide table (with the zone's name), the index's columns, and the chunks' numbers."""
    from gridweave.functions.bands import columns_of

    names = columns_of(wide, prefix)
    numbers = spread(-(-total // chunk), n_chunks)
    return sample_chunks(wide.select("pixel_id", "lon", "lat", *names), numbers, chunk).withColumn("zone", F.lit(zone)), names, numbers


def audit(wide: DataFrame, zone: str, chunk: int = CHUNK, n_chunks: int = 5, low: float = LOW, prefix: str = "NDVI_") -> DataFrame:
    """Audit of a wide table (pixel_id, lon, lat, bands) from evenly spread chunks."""
    from gridweave.operators.merge import unpivot_long

    total = wide.count()
    sample, names, numbers = sampled(wide, zone, total, chunk, n_chunks, prefix)
    facts = {"total_rows_full_dataset": F.lit(total), "total_cols_full_dataset": F.lit(len(wide.columns)), "n_ndvi_columns": F.lit(len(names)), "sample_row_groups": F.array(*map(F.lit, numbers))}
    sized = sample.groupBy("zone").agg(F.count("*").alias("sample_size_rows"))
    return summary(unpivot_long(sample, ["zone", "pixel_id"], names), low).join(extent(sample), "zone").join(sized, "zone").withColumns(facts)


EXTENT = ["lon_min", "lon_max", "lat_min", "lat_max"]


def audit_zone(spark, zone: str, path: str, out: str, low: float = LOW, n_chunks: int = 5, chunk: int = CHUNK, prefix: str = "NDVI_") -> dict:
    """The audit of a zone's table as a dict, written as JSON with the time of the
    audit; a histogram is drawn beside it if a drawing library is there."""
    from datetime import UTC, datetime
    from pathlib import Path

    from gridweave.operators import render
    from gridweave.operators.merge import unpivot_long

    wide = spark.read.parquet(path)
    row = audit(wide, zone, chunk, n_chunks, low, prefix).first().asDict()
    row["sample_geo_extent"] = {k: row.pop(k) for k in EXTENT}
    found = {"zone": zone, "parquet_path": path, "audit_timestamp_utc": datetime.now(UTC).isoformat(), **{k: v for k, v in row.items() if k != "zone"}}
    Path(out).mkdir(parents=True, exist_ok=True)
    found = render.write_json(found, f"{out}/{zone}_quality_summary.json")
    sample, names, _ = sampled(wide, zone, row["total_rows_full_dataset"], chunk, n_chunks, prefix)
    bars = [r.asDict() for r in histogram(unpivot_long(sample, ["zone", "pixel_id"], names)).orderBy("bin").collect()]
    return {**found, "figure_path": render.draw_if_possible({zone: bars}, f"{out}/{zone}_distribution.png"), "histogram": bars}


def compare_zones(summaries: Sequence[dict], out: str, title: str = "Data quality by zone") -> tuple[str | None, str]:
    """A figure (if it can be drawn) and a Markdown table of what `audit_zone` gave; their paths."""
    from datetime import UTC, datetime
    from pathlib import Path

    from gridweave.operators import render

    share = lambda x: "n/a" if x is None else f"{x:.2%}"
    number = lambda x: "n/a" if x is None else f"{x:.3f}"
    rows = [
        {
            "Zone": s["zone"],
            "Total pixels": f"{s['total_rows_full_dataset']:,}",
            "NaN frac (mean)": share(s["nan_fraction_mean"]),
            "NaN frac (median)": share(s["nan_fraction_median"]),
            "Valid range": f"[{number(s['valid_value_min'])}, {number(s['valid_value_max'])}]",
            "Valid mean": number(s["valid_value_mean"]),
            "% negative": share(s["pct_negative"]),
            f"% below {s['ndvi_low_threshold_used']}": share(s["pct_below_low_threshold"]),
        }
        for s in summaries
    ]
    Path(out).mkdir(parents=True, exist_ok=True)
    table = Path(out) / "cross_zone_quality_table.md"
    table.write_text(render.markdown(rows, title, datetime.now(UTC).isoformat()))
    return render.draw_if_possible({s["zone"]: s["histogram"] for s in summaries}, f"{out}/cross_zone_comparison.png"), str(table)
