"""One-shot sync of folders into the transaction log.

List, compare with the store, read only what is stale, append one transaction.
Run it on a schedule to follow mutable folders: the log it appends to is what
``firings`` streams.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions import paths as P
from tidemark.operators import store as St
from tidemark.session import cut
from tidemark.sources import files as Fs, markdown as Md, readers as R
from tidemark.sources.edn import edn_reader

_LOGGED = "id string, op string, modified timestamp, parent string, doc variant, op_seq long, tx_time timestamp, tx_id long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log below ``path``; empty before its first transaction. One that is there and cannot be read is an error."""
    try:
        return spark.read.schema(_LOGGED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOGGED)


def sync_folders(
    spark: SparkSession,
    mounts: dict[str, str | dict],
    log_path: str,
    tx_id: int,
    tx_time: Column,
    force: str | None = None,
    readers: R.ReaderTable | None = None,
    config: dict | None = None,
) -> DataFrame:
    """Append one transaction with every change below the mounts; returns the stale ``(id, op)``.

    ``force`` reads again whatever matches a glob over ids, stale or not. An
    attempt repeated with the same ``tx_id`` overwrites its own transaction.
    """
    config = config or {}
    listing = cut(Fs.mount_files(spark, mounts, config.get("ignore"), config.get("extra_ignore"), folders=True))
    seen = Fs.latest_modified(listing)
    earlier = read_log(spark, log_path).filter(F.col("tx_id") < tx_id)
    stored = St.as_of(earlier, columns=["modified"]).select("id", "modified")
    ops = St.sync_ops(seen, stored)
    if force is not None:
        again = seen.filter(P.matches_glob(F.col("id"), force)).select(
            "id", F.lit("put").alias("op"), "modified")
        ops = ops.join(again, "id", "left_anti").unionByName(again)
    ops = cut(ops)

    wanted = listing.join(ops.filter("op = 'put'").select("id"), "id", "left_semi")
    specs = {m: s if isinstance(s, dict) else {} for m, s in mounts.items()}
    # only files somebody reads are opened
    content = wanted.filter(~F.col("is_sidecar") & ~F.col("is_dir") & R.is_read("id", readers, config, specs))
    text = cut(Fs.read_paths(content).join(content.select("id", "mount", "rel"), "id"))
    docs = R.read_documents(text, readers, config, specs)
    vault = listing.filter(~F.col("is_sidecar") & ~F.col("is_dir"))
    notes = text.filter(P.extension(F.col("id")) == "md")
    refs = Md.ref_pairs(Md.markdown_refs(notes, vault))
    content_docs = docs.select("id", "doc").unionByName(refs)
    sidecars = edn_reader(Fs.read_paths(wanted.filter("is_sidecar")))
    puts = R.assemble(ops.filter("op = 'put'").select("id", "modified"), content_docs, sidecars)
    rows = puts.withColumn("op", F.lit("put")).unionByName(
        ops.filter("op = 'delete'").select("id", "op", "modified"), allowMissingColumns=True)
    St.append_ops(rows, log_path, tx_id, tx_time)
    return ops.select("id", "op")

