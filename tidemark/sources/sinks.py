"""Writing results: saved queries, changed results, documents as markdown."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.queries import has_changed


class SavedQueries:
    """Named queries and where their results go."""

    def __init__(self, out: str) -> None:
        self.out = out
        self.queries: dict[str, Callable[[SparkSession], DataFrame]] = {}

    def register(self, name: str, query: Callable[[SparkSession], DataFrame]) -> None:
        self.queries[name] = query

    def run(self, spark: SparkSession, name: str) -> str:
        """Write a query's result under ``<out>/<name>``; an error is written as its message."""
        path = f"{self.out}/{name}"
        try:
            self.queries[name](spark).write.mode("overwrite").parquet(path)
        except Exception as e:  # the error is the result, as for a query that fails
            message = str(e).splitlines()[0]
            spark.range(1).select(F.lit(message).alias("error")).write.mode("overwrite").parquet(path)
        return path


def write_if_changed(new: DataFrame, folder: str) -> bool:
    """Write a result as the folder's next version unless it equals the newest one.

    Versions are numbered folders, so a result is never overwritten while it is read.
    """
    spark = new.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = []
    if fs.exists(root):
        for s in fs.listStatus(root):
            name = s.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")):
                done.append(int(name[2:]))
    if done and not has_changed(spark.read.parquet(f"{folder}/v={max(done)}"), new):
        return False
    new.write.mode("overwrite").parquet(f"{folder}/v={max(done, default=0) + 1}")
    return True


def markdown_lines(rows: DataFrame, doc: Column, key: Column, value: Column) -> DataFrame:
    """Front matter of documents as ordered lines ``(doc, part, key, line)``: fences and sorted ``key: value``.

    Lines stay rows, so a document of any length is written by as many tasks as it needs.
    """
    body = rows.select(
        doc.alias("doc"), F.lit(1).alias("part"), key.alias("key"),
        F.concat(key, F.lit(": "), value.cast("string")).alias("line"))
    docs = rows.select(doc.alias("doc")).distinct()
    fences = docs.select(
        "doc", F.explode(F.array(F.lit(0), F.lit(2))).alias("part"), F.lit("").alias("key"), F.lit("---").alias("line"))
    return body.unionByName(fences)


def write_markdown(lines: DataFrame, out: str) -> None:
    """One folder per document with its lines in order, part files in name order."""
    (
        lines.repartitionByRange("doc", "part", "key").sortWithinPartitions("doc", "part", "key")
        .select("doc", "line").write.mode("overwrite").partitionBy("doc").text(out)
    )
