"""JSON snapshots: several tables of a report as one document, and their reader."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def snapshot(parts: dict[str, DataFrame | dict | list]) -> str:
    """One pretty-printed document. Its tables are report-sized: they feed a page."""
    out = {k: [r.asDict(recursive=True) for r in v.collect()] if isinstance(v, DataFrame) else v for k, v in parts.items()}
    return json.dumps(out, indent=2, default=str, ensure_ascii=False)


def without_data(artifact: str, snapshots: list[str]) -> None:
    """Raise if a code artifact (a page's template, a script) holds a snapshot: its data slots must be null and no key of a payload may stand there as JSON."""
    text = Path(artifact).read_text()
    keys = {k for path in snapshots for k in _keys(json.loads(Path(path).read_text()))}
    # words of one letter case occur in any code; a payload's keys have an underscore
    found = sorted(k for k in keys if "_" in k and re.search(rf'"{re.escape(k)}"\s*:', text))
    filled = re.findall(r"(?:let|var|const)\s+([A-Z][A-Z0-9_]*)\s*=\s*(?:\{\s*[\"']|\[\s*[\{\[\"'\d])", text)
    if found or filled:
        raise ValueError(f"{artifact} holds data: " + ", ".join(found + filled))


def _keys(node) -> set[str]:
    if isinstance(node, dict):
        return set(node) | {k for v in node.values() for k in _keys(v)}
    return {k for v in node for k in _keys(v)} if isinstance(node, list) else set()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)
