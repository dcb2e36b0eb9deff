"""Configuration from YAML, read on the driver."""

from __future__ import annotations

from pathlib import Path


def load(path: str) -> dict:
    """Raises FileNotFoundError if the file is missing.  Strings that are
    numbers with an exponent (which YAML 1.1 reads as text) become numbers."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(f"no configuration at {path}")
    return _numbers(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})


def load_all(folder: str, base: str = "base_config.yaml", export: str = "gee_config.yaml") -> dict:
    """The base configuration with the export's under `gee`."""
    return {**load(f"{folder}/{base}"), "gee": load(f"{folder}/{export}")}


def _numbers(x):
    if isinstance(x, dict):
        return {k: _numbers(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_numbers(v) for v in x]
    if isinstance(x, str) and "e" in x.lower() and x[:1].isdigit():
        try:
            return float(x)
        except ValueError:
            return x
    return x
