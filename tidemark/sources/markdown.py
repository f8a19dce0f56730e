"""Markdown documents: front matter and links."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import paths as P, text as X
from tidemark.model import NAMESPACE
from tidemark.operators.graph import refs_of, resolve_links
from tidemark.session import cut
from tidemark.sources.edn import to_json as edn_to_json


def _plain(v):
    """YAML value → JSON value; dates are midnight UTC instants."""
    if isinstance(v, dt.datetime):
        v = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return v.astimezone(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    if isinstance(v, dt.date):
        return v.strftime("%Y-%m-%dT00:00:00Z")
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple, set)):
        return [_plain(x) for x in v]
    return v


def front_matter_json(yml: str | None, namespace: str) -> str | None:
    """JSON object of YAML front matter; reserved attributes are read again as EDN."""
    import yaml

    if not yml:
        return None
    try:
        data = yaml.load(yml, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    if not isinstance(data, dict):
        return None
    out = _plain(data)
    for k in list(out):
        ns = k.split("/", 1)[0] if "/" in k else ""
        if ns == namespace or ns.startswith(namespace + "."):
            v = out[k]
            if isinstance(v, str):
                v = json.loads(edn_to_json(v) or "null")
            elif isinstance(v, list):
                v = [json.loads(edn_to_json(x) or "null") if isinstance(x, str) else x for x in v]
            else:
                v = None
            # what reads as nothing leaves the attribute as it was written
            if v is not None and v != [] and v != {}:
                out[k] = v
    return json.dumps(out, ensure_ascii=False)


def parse_front_matter(md: Column, namespace: str = NAMESPACE) -> Column:
    @F.pandas_udf(T.StringType())
    def to_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: front_matter_json(t, namespace))

    return F.try_parse_json(to_json(X.front_matter(md)))


def is_reserved(key: Column, namespace: str = NAMESPACE) -> Column:
    """Whether an attribute name lies in the reserved namespace or one below it."""
    return key.rlike(rf"^{namespace}(\.[^/]*)?/")


def links_of(files: DataFrame) -> DataFrame:
    """``(src, vault, link)`` of markdown files ``(id, mount, rel, text)``, links in front matter included."""
    folder = F.when(F.col("rel").contains("/"), P.parent_of(F.col("rel"))).otherwise(F.lit(""))
    found = F.concat(X.wikilinks(F.col("text")), X.mdlinks(F.col("text"), folder))
    return files.select(
        F.col("id").alias("src"), F.col("mount").alias("vault"), F.explode(F.array_distinct(found)).alias("link"))


def markdown_refs(files: DataFrame, vault_files: DataFrame, strict: bool = False) -> DataFrame:
    """``(src, dst)`` references of markdown files into their vault ``(mount, rel)``."""
    links = cut(links_of(files))  # the texts are read once
    targets = vault_files.select(F.col("mount").alias("vault"), F.col("rel").alias("path"))
    resolved = resolve_links(links, targets, strict)
    return refs_of(links, resolved, P.doc_id(F.col("vault"), F.col("target")))


def md_reader(files: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """Front matter as a document. References need the whole vault: see ``with_refs``."""
    return files.select("id", parse_front_matter(F.col("text"), namespace).alias("doc"))


def ref_pairs(refs: DataFrame, namespace: str = NAMESPACE) -> DataFrame:
    """References as ``(id, doc)`` with the one attribute ``<ns>/refs``, sorted and distinct.

    One document's references are its own content, so the group is bounded by it.
    """
    grouped = refs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("r"))
    return grouped.select(
        "id", F.to_variant_object(F.map_from_arrays(F.array(F.lit(f"{namespace}/refs")), F.array("r"))).alias("doc"))
