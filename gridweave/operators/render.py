"""Small results as JSON, Markdown and, if a drawing library is there, figures."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame) -> DataFrame:
    """A JSON object for each row; doubles with six decimals, so that no number is written with an exponent."""
    columns = [F.col(f.name).cast("decimal(28,6)").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(summary: dict, path: str) -> dict:
    """Writes the summary; only what is returned names the file too."""
    Path(path).write_text(json.dumps(summary, indent=2, default=str))
    return {**summary, "json_path": path}


def markdown(rows: Sequence[dict], title: str, generated: str) -> str:
    if not rows:
        return f"# {title}\n\nGenerated: {generated}\n"
    names = list(rows[0])
    lines = ["| " + " | ".join(names) + " |", "|" + "|".join(" --- " for _ in names) + "|"]
    lines += ["| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows]
    return f"# {title}\n\nGenerated: {generated}\n\n" + "\n".join(lines) + "\n"


def draw_if_possible(histograms: dict[str, Sequence[dict]], path: str) -> str | None:
    """The figure's path, or none if there is no drawing library."""
    from importlib.util import find_spec

    return draw_histograms(histograms, path) if histograms and find_spec("matplotlib") else None


def draw_histograms(histograms: dict[str, Sequence[dict]], path: str, dpi: int = 600) -> str:
    """One panel for each named histogram (rows of low, high and n)."""
    import matplotlib

    matplotlib.use("Agg")
    import matplotlib.pyplot as plt

    figure, axes = plt.subplots(1, len(histograms), figsize=(6 * len(histograms), 4), squeeze=False)
    for axis, (name, rows) in zip(axes[0], histograms.items()):
        axis.bar([r["low"] for r in rows], [r["n"] for r in rows], width=[r["high"] - r["low"] for r in rows], align="edge")
        axis.set_title(name)
    figure.savefig(path, dpi=dpi)
    plt.close(figure)
    return path
