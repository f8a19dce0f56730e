"""Files under mounts as rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import paths as P
from tidemark.session import cut


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, modified, length)`` of the non-empty files below ``root``; contents are not read."""
    scan = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).load(root)
    )
    return scan.select("path", F.col("modificationTime").alias("modified"), "length")


# About what one task reads.
READ_BYTES = 64 << 20

_LISTED = "path string, is_dir boolean, modified_us long, length long"


def _list_folders(batches: Iterator[pd.DataFrame], must_exist: bool) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    for batch in batches:
        for folder in batch["path"]:
            store, plain = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
            scheme = folder[: len(folder) - len(plain)]
            found = store.get_file_info(pafs.FileSelector(plain, allow_not_found=not must_exist))
            for at in range(0, len(found), 10_000):
                yield pd.DataFrame(
                    [(scheme + f.path, f.type == pafs.FileType.Directory,
                      None if f.mtime_ns is None else f.mtime_ns // 1000, f.size or 0)
                     for f in found[at:at + 10_000]],
                    columns=["path", "is_dir", "modified_us", "length"])


def _read_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs as pafs

    def bytes_of(path: str) -> bytes | None:
        store, plain = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        try:
            with store.open_input_stream(plain) as f:
                return f.read()
        except FileNotFoundError:
            return None

    for batch in batches:
        for row in batch.itertuples(index=False):  # one file in memory at a time
            data = bytes_of(row.path)
            try:
                text, raw = None if data is None else data.decode("utf-8"), None
            except UnicodeDecodeError:
                text, raw = data.decode("utf-8", errors="replace"), data
            yield pd.DataFrame([(row.id, row.path, text, raw)], columns=["id", "path", "text", "raw"])


def read_paths(files: DataFrame) -> DataFrame:
    """``(id, path, text, raw)`` of listed files ``(id, path)``: only these are opened, by the tasks.

    ``raw`` holds the bytes of files that are not UTF-8, for readers that know their charset;
    in their text what cannot be read is replaced.
    The number of tasks follows from the bytes to read where the listing knows them, and
    is set explicitly: paths are tiny, so sizes of shuffled paths would put them all in one.
    """
    spark = files.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if "length" in files.columns:
        n = max(n, -(-(files.agg(F.sum("length")).first()[0] or 0) // READ_BYTES))
    return files.select("id", "path").repartition(n, "path").mapInPandas(_read_paths, "id string, path string, text string, raw binary")


def qualified(spark: SparkSession, path: str) -> str:
    """A plain path as one on the cluster's default file system, if it has one."""
    default = spark.conf.get("spark.hadoop.fs.defaultFS", None)
    if "://" in path or not default or default.startswith("file:"):
        return path
    return default.rstrip("/") + path


def walk_files(spark: SparkSession, root: str, skip: list[str] | None = None, folders: bool = False) -> DataFrame:
    """``(path, modified, length, is_dir)`` of every file below ``root``, empty ones too, and with ``folders`` of the folders.

    File scans leave empty files out, but an empty file is a document. Folders are
    listed by tasks, one level of the tree per round; folders ``skip`` names are not
    entered. A root that is not there is an error: an unreachable mount must not look
    like one whose files are all gone. A folder that goes while it is walked is empty.
    """
    root = qualified(spark, root)
    below = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, first = None, True
    while True:
        list_folders = functools.partial(_list_folders, must_exist=first)
        level = cut(below.repartition(n, "path").mapInPandas(list_folders, _LISTED))
        first = False
        if skip:
            level = level.filter(~P.is_ignored(P.file_name(F.col("path")), skip))
        here = level.filter(F.lit(folders) | ~F.col("is_dir")).select(
            "path", F.timestamp_micros("modified_us").alias("modified"), "length", "is_dir")
        files = here if files is None else files.unionByName(here)
        below = level.filter("is_dir").select("path")
        if below.isEmpty():
            return files


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``, from a file URI (percent-decoded) or a plain path."""
    plain = F.regexp_replace(path, "^[a-z][a-z0-9+.-]*:/*", "/")
    decoded = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    plain = F.when(path.rlike("^[a-z][a-z0-9+.-]*:"), decoded).otherwise(plain)
    return F.substring(plain, len(root.rstrip("/")) + 2, 1 << 30)


def mount_files(
    spark: SparkSession,
    mounts: dict[str, str | dict],
    ignore: list[str] | None = None,
    extra_ignore: list[str] | None = None,
    text: bool = False,
    pattern: str = "**",
    folders: bool = False,
) -> DataFrame:
    """Files of every mount with ``mount, rel, id, is_sidecar``, ignored paths dropped.

    With ``folders`` the folders below the mounts are rows too, marked ``is_dir``.

    With ``text`` the contents are read too. Which files there are does not depend on it:
    empty files are documents.

    A mount is a folder or ``{"path": …, "ignore": […]}``; its own ignore list adds
    to the global one.
    """
    out = None
    for name, spec in mounts.items():
        spec = {"path": spec} if isinstance(spec, str) else spec
        root = spec["path"]
        names = P.ignore_list(ignore, list(extra_ignore or []) + list(spec.get("ignore", [])))
        scan = walk_files(spark, root, names, folders)
        rel = relative_to(F.col("path"), root)
        part = (
            scan.withColumn("mount", F.lit(name)).withColumn("rel", rel)
            .filter(~P.is_ignored(F.col("rel"), names) & P.matches_glob(F.col("rel"), pattern))
            .withColumn("id", P.doc_id(F.col("mount"), F.col("rel")))
            .withColumn("is_sidecar", P.is_sidecar(F.col("rel")))
        )
        out = part if out is None else out.unionByName(part)
    if text:
        out = cut(out)
        read = read_paths(out.filter(~F.col("is_dir"))).select(F.col("path").alias("__path"), "text")
        out = out.join(read, F.col("path") == F.col("__path"), "left").drop("__path", "length")
    return out


def latest_modified(files: DataFrame) -> DataFrame:
    """``(id, modified)``: the later of content and sidecar."""
    return files.groupBy("id").agg(F.max("modified").alias("modified"))


def path_to_id(path: Column, mounts: dict[str, str]) -> Column:
    """Id of a path under a mount; a path that already is an id is kept, others are null."""
    out = F.lit(None).cast("string")
    for name, root in reversed(list(mounts.items())):
        prefix = f"/{name}/"
        rel = F.regexp_replace(F.substring(path, len(root) + 1, 1 << 30), "^/", "")
        out = (
            F.when(path.startswith(prefix), path)
            .when(path.startswith(root), P.doc_id(F.lit(name), rel))
            .otherwise(out)
        )
    return out


def id_to_path(id_: Column, mounts: dict[str, str]) -> Column:
    """File path of an id; null for ids without a path or of an unknown mount."""
    mount = P.mount_of(id_)
    root = F.lit(None).cast("string")
    for name, path in mounts.items():
        root = F.when(mount == name, F.lit(path.rstrip("/"))).otherwise(root)
    return F.concat(root, F.lit("/"), P.relative_of(id_))


def folder_docs(docs: DataFrame) -> DataFrame:
    """The folders above documents, which are documents too."""
    up = docs.select(F.explode(P.ancestors(F.col("id"))).alias("id")).filter(F.col("id") != "")
    return up.distinct().withColumn("parent", P.parent_of(F.col("id")))


def csv_docs(spark: SparkSession, path: str, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """``(id, doc VARIANT)`` per row of a CSV with a header, all values strings."""
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"')
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return row_docs(reader.csv(path), id_column)


def row_docs(rows: DataFrame, id_column: str) -> DataFrame:
    """Rows as documents: ``doc`` holds every column as a VARIANT object."""
    return rows.select(
        F.col(id_column).cast("string").alias("id"),
        F.to_variant_object(F.struct(*[F.col(c) for c in rows.columns])).alias("doc"))
