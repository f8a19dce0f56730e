"""Readers turn file rows ``(id, ext, text)`` into ``(id, prio, doc VARIANT)``.

A reader is a function from DataFrame to DataFrame. Which readers an extension
has, and in what order, is resolved from configuration; the outputs are merged
shallowly, later readers winning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.paths import extension, mount_of
from tidemark.operators.merge import merge_documents

Reader = Callable[[DataFrame], DataFrame]
ReaderTable = dict[str, "Reader | list[Reader]"]


def json_reader(files: DataFrame) -> DataFrame:
    return files.select("id", F.try_parse_json("text").alias("doc"))


def as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def resolve_readers(
    ext: str, defaults: ReaderTable, config: dict | None = None, mount: dict | None = None
) -> list[Reader]:
    """Readers of an extension: the mount's, else the configuration's, else the
    defaults; then the extra ones of the configuration and of the mount."""
    config, mount = config or {}, mount or {}
    base = mount.get("readers") or config.get("readers") or defaults
    tables = [base, config.get("extra_readers") or {}, mount.get("extra_readers") or {}]
    return [r for t in tables if ext in t for r in as_list(t[ext])]


def default_readers() -> ReaderTable:
    from tidemark.sources.edn import edn_reader
    from tidemark.sources.mail import eml_reader
    from tidemark.sources.markdown import md_reader

    return {"json": json_reader, "edn": edn_reader, "md": md_reader, "eml": eml_reader}


def _plan(readers: ReaderTable | None, config: dict | None, mounts: dict[str, dict] | None) -> list[tuple[Reader, dict]]:
    """Each distinct reader with the (mount, extension) pairs it reads and its place among their readers."""
    readers = default_readers() if readers is None else readers
    tables = [readers] + [
        t for c in [config or {}, *(mounts or {}).values()]
        for t in (c.get("readers") or {}, c.get("extra_readers") or {})
    ]
    found: dict[int, tuple[Reader, dict]] = {}
    for ext in sorted({e for t in tables for e in t}):
        for name in mounts or {"": {}}:
            for prio, reader in enumerate(resolve_readers(ext, readers, config, (mounts or {}).get(name))):
                # a reader named twice gives the same document twice: its last place counts
                found.setdefault(id(reader), (reader, {}))[1][name, ext] = prio
    return list(found.values())


def _place(id_: str, places: dict, mounts: dict | None) -> Column:
    """Place of a reader for a document, null where it does not read it."""
    out = F.lit(None).cast("int")
    for (name, ext), prio in places.items():
        here = extension(F.col(id_)) == ext
        if mounts:
            here = here & (mount_of(F.col(id_)) == name)
        out = F.when(here, F.lit(prio)).otherwise(out)
    return out


def is_read(
    id_: str, readers: ReaderTable | None = None, config: dict | None = None, mounts: dict[str, dict] | None = None
) -> Column:
    """Whether any reader reads a document; notes are read for their links in any case."""
    out = F.coalesce(extension(F.col(id_)) == "md", F.lit(False))
    for _, places in _plan(readers, config, mounts):
        out = out | _place(id_, places, mounts).isNotNull()
    return out


def read_documents(
    files: DataFrame,
    readers: ReaderTable | None = None,
    config: dict | None = None,
    mounts: dict[str, dict] | None = None,
) -> DataFrame:
    """Run each file's readers and merge what they give: ``(id, doc)``.

    ``files`` has ``id, mount, text``. There is one branch per distinct reader, however
    many mounts and extensions it serves. Only objects count; a file whose readers
    give none has no row here (its document still exists through its listing).
    """
    docs = None
    for reader, places in _plan(readers, config, mounts):
        place = _place("id", places, mounts)
        part = reader(files.filter(place.isNotNull())).select("id", place.alias("prio"), "doc")
        docs = part if docs is None else docs.unionByName(part)
    if docs is None:
        return files.sparkSession.createDataFrame([], "id string, doc variant")
    return merge_documents(docs.filter(F.schema_of_variant("doc").startswith("OBJECT")))


def assemble(listing: DataFrame, content: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Documents of listed files: reader data under sidecar data under identity columns.

    ``listing(id, modified)``, ``content(id, doc)``, ``sidecars(id, doc)``.
    """
    both = content.select("id", F.lit(0).alias("prio"), "doc").unionByName(
        sidecars.select("id", F.lit(1).alias("prio"), "doc"))
    merged = merge_documents(both.filter(F.schema_of_variant("doc").startswith("OBJECT")))
    return listing.join(merged, "id", "left").select(
        "id", "modified", F.regexp_replace("id", "/[^/]*$", "").alias("parent"), "doc")

