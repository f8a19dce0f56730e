"""Nested documents to one document per nested map."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def split_maps(text: str | None, prefix: str) -> list[dict] | None:
    """``[{path, doc}]`` of a JSON value, each doc as JSON text; see ``nested_maps``."""
    found = nested_maps(text, prefix)
    return found and [{"path": x["path"], "doc": json.dumps(x["doc"], ensure_ascii=False)} for x in found]


def nested_maps(text: str | None, prefix: str) -> list[dict] | None:
    """``[{path, doc}]`` of a JSON value, inner maps first: each map with references in its nested maps' place.

    A reference is ``<prefix><path>.edn``. None when no map is nested in the value.
    """
    value = json.loads(text) if text else None
    if isinstance(value, list):
        value = {str(i): v for i, v in enumerate(value)}
    if not isinstance(value, dict):
        return None
    found: list[dict] = []

    def walk(v, path: str):
        below = lambda k: f"{path}.{k}" if path else str(k)
        if isinstance(v, dict):
            doc = {k: walk(x, below(k)) for k, x in v.items()}
            found.append({"path": path or "root", "doc": doc})
            return f"{prefix}{path}.edn"
        if isinstance(v, list):
            return [walk(x, below(i)) for i, x in enumerate(v)]
        return v

    walk(value, "")
    return found if len(found) > 1 else None


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per document with all of its maps, encoded at once."""
    encode = json.JSONEncoder(ensure_ascii=False).encode
    for batch in batches:
        rows = []
        for id_, text in zip(batch["id"], batch["doc"]):
            found = nested_maps(text, f"{id_}.explode/")
            if found:
                rows.append((id_, encode(found)))
        yield pd.DataFrame(rows, columns=["source", "pieces"], dtype=object)


def explode_nested(docs: DataFrame) -> DataFrame:
    """``(id, doc VARIANT)`` → one row ``(source, id, doc)`` per map, references in the nested maps' place.

    A child is named ``<source>.explode/<path>.edn`` and the document itself
    ``<source>.explode/root.edn``. An array at the top counts as a map from index
    to value; documents without a nested map give no row. A document is one row,
    so this needs no shuffle.
    """
    rows = docs.select("id", F.to_json("doc").alias("doc")).mapInPandas(_pieces, "source string, pieces string")
    pieces = rows.select("source", F.explode(F.from_json("pieces", "array<struct<path:string,doc:variant>>")).alias("piece"))
    return pieces.select(
        "source", F.concat("source", F.lit(".explode/"), "piece.path", F.lit(".edn")).alias("id"),
        F.col("piece.doc").alias("doc"))
