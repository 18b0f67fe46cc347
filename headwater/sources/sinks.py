"""Reports written as JSON or Parquet, one table each."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_reports(tables: dict[str, DataFrame], path: str, kind: str = "json", mode: str = "overwrite") -> list[str]:
    """Writes each table to a folder of its name; returns the folders."""
    out = []
    for name, df in tables.items():
        out.append(f"{path.rstrip('/')}/{name}")
        df.write.mode(mode).format(kind).save(out[-1])
    return out
