"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a document's language are multiplied:

* *text*: log likelihood of the letter trigrams of the whole text under each
  language's trigram model and under a background of evenly spread trigrams, the
  language "und". Trigrams overlap, so the sum is divided by ``TEMPER``.
* *declared* language, such as the ``lang`` attribute of a page, and
* *suffix* of the address, its country or top-level domain: P(value | language),
  counted over all rows by their language as the text alone tells it.
* *host*: a prior P(language | host), smoothed towards the prior of the registered
  domain, that towards the prior of the whole table; each level weighs as ``ALPHA``
  rows. The counts are one grouped aggregation, combined on the map side.

A missing value is no evidence. A document is rejected when its best language is
"und" or has a posterior below ``MIN_POSTERIOR``. A text without letters has no text
evidence and is rejected: nothing in it is in a language. Ties go to the language
first in alphabetical order.

Trigram models are fitted on labelled rows (``fit``), all of them, as counts in a
fixed number of bins. Every labelled language has a model: the counts stay a table, and
texts are scored in blocks of ``BLOCK_LANGUAGES``, so the driver and each task hold bins x
that many numbers; what a block has found passes through a written table to the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_batches, bytes_of, tidy
from tidemark.session import cut

BINS = 1 << 15
TEMPER = 4.0
ALPHA = 20.0
SMOOTH = 0.5
MIN_POSTERIOR = 0.65
BLOCK_LANGUAGES = 64
UNKNOWN = "und"
CHUNK = 1 << 20


def _folded(data: bytes) -> np.ndarray:
    """Lower-cased letters as bytes, with one zero for each run of anything else, and at both ends."""
    raw = np.frombuffer(b"\0" + data.decode("utf-8", "replace").lower().encode() + b"\0", np.uint8)
    kept = np.where((raw >= 128) | ((raw >= 97) & (raw <= 122)), raw, 0).astype(np.uint8)
    return kept[(kept != 0) | np.concatenate([[True], kept[:-1] != 0])]


def trigrams(data: bytes | None) -> np.ndarray:
    """Bins of the byte trigrams of a text; none if it has no letters."""
    folded = _folded(bytes(data)) if data else np.zeros(0, np.uint8)
    if len(folded) < 3:
        return np.zeros(0, np.int64)
    x = folded.astype(np.uint32)
    mixed = (x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D))
    return ((mixed ^ (mixed >> np.uint32(15))) % np.uint32(BINS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray | None = None  # bins x languages, the last for the background
    counted: DataFrame | None = None  # lang, bin and n, instead of logs
    block_languages: int = BLOCK_LANGUAGES

    def blocks(self) -> Iterator[Model]:
        """Models with logs for parts of the languages, each with the background; one part at a time is on the driver."""
        if self.counted is None:
            yield self
            return
        for low in range(0, len(self.languages), self.block_languages):
            part = self.languages[low:low + self.block_languages]
            logs = np.full((BINS, len(part) + 1), -np.log(BINS))
            own = self.counted.filter(F.col("lang").isin(part)).toPandas()
            for k, lang in enumerate(part):
                rows = own[own["lang"] == lang]
                sums = np.full(BINS, 0.02)
                sums[rows["bin"].to_numpy()] += rows["n"].to_numpy()
                logs[:, k] = np.log(sums / sums.sum())
            yield Model(part, logs)

    def likelihoods(self, data: bytes | None) -> tuple[int, list[float]]:
        """Number of trigrams and the sum of their logarithms for each language and the background."""
        bins = trigrams(data)
        total = np.zeros(self.logs.shape[1])
        for low in range(0, len(bins), CHUNK):
            total += self.logs[bins[low:low + CHUNK]].sum(axis=0)
        return len(bins), total.tolist()


def fit(rows: DataFrame, text: str, label: str, block_languages: int = BLOCK_LANGUAGES) -> Model:
    """Trigram models of all languages that ``label`` names."""
    bounded_batches(rows.sparkSession)
    labelled = rows.filter(F.col(label).isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, own in sums.items():
                used = np.flatnonzero(own)
                yield pd.DataFrame({"lang": lang, "bin": used, "n": own[used]})
            sums.clear()

        for batch in batches:
            for lang, data in zip(batch["lang"], batch["data"]):
                if lang not in sums and len(sums) >= block_languages:
                    yield from rows()
                own = sums.setdefault(lang, np.zeros(BINS, np.int64))
                bins = trigrams(data)
                for low in range(0, len(bins), CHUNK):
                    own += np.bincount(bins[low:low + CHUNK], minlength=BINS)
        yield from rows()

    counted = labelled.select(F.col(label).cast("string").alias("lang"), bytes_of(text).alias("data")).mapInPandas(
        tidy(count), "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    counted = cut(counted)
    # a row per language, however many documents there are
    return Model(sorted(r.lang for r in counted.select("lang").distinct().collect()), None, counted, block_languages)


def text_evidence(model: Model, text: str) -> Column:
    """Struct of n (trigrams) and logs, the likelihoods of the languages and the background."""
    shared = (model.languages, model.logs)

    @F.pandas_udf("n bigint, logs array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared)
        for batch in batches:
            yield pd.DataFrame([own.likelihoods(d) for d in batch], columns=["n", "logs"])

    return evidence(bytes_of(text))


def host_of(url: Column) -> Column:
    """Host of an address, lower-cased; null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def domain_of(host: Column) -> Column:
    """The last two labels of a host: its registered domain, roughly."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The last label of a host."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def declared_of(html: Column) -> Column:
    """Primary language tag that a page declares; null if it declares none."""
    tag = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]+)""", 1))
    return F.when(tag != "", tag)


def _winner(logs: Column, languages: list[str]) -> Column:
    names = F.array(*[F.lit(x) for x in languages])
    return F.element_at(names, F.array_position(logs, F.array_max(logs)).cast("int"))


def _priors(rows: DataFrame, languages: list[str]):
    """Tables of log P(language | host) and of log P(value | language) for declared and suffix.

    Counts are kept a row per key and language seen there, and are spread over all languages last.
    """
    zero, each = F.array(*[F.lit(0.0)] * len(languages)), F.sequence(F.lit(0), F.lit(len(languages) - 1))
    counts = cut(rows.groupBy("host", "domain", "said", "suffix", (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(
        "guess")) - 1).cast("int").alias("at")).agg(F.count("*").cast("double").alias("c")))
    known = lambda own: [own.get(k, 0.0) for k in range(len(languages))]
    total = known({r["at"]: r["c"] for r in counts.filter("at >= 0").groupBy("at").agg(F.sum("c").alias("c")).collect()})
    base = [(t + 1.0) / (sum(total) + len(total)) for t in total]

    def spread(*keys: str) -> DataFrame:
        """``keys`` with counts cs for all languages; rows without a guess count for none."""
        seen = counts.groupBy(*keys, "at").agg(F.sum("c").alias("c"))
        entries = F.collect_list(F.when(F.col("at") >= 0, F.struct("at", "c")))
        n = F.sum(F.when(F.col("at") >= 0, F.col("c")))
        return seen.groupBy(*keys).agg(F.map_from_entries(entries).alias("m"), F.coalesce(n, F.lit(0.0)).alias("n")).select(
            *keys, "n", F.transform(each, lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("cs"))

    def smoothed(towards: Column) -> Column:
        return F.zip_with("cs", towards, lambda c, p: (c + ALPHA * p) / (F.col("n") + ALPHA))

    domains = spread("domain").filter("domain is not null").select("domain", smoothed(F.array(*[F.lit(p) for p in base])).alias("ds"))
    hosts = spread("host", "domain").filter("host is not null")
    hosts = cut(hosts.join(domains, "domain").select(F.col("host").alias("__host"), F.transform(
        smoothed(F.col("ds")), lambda p: F.log(p)).alias("__prior")))

    def given(column: str) -> DataFrame:
        seen = counts.filter(F.col(column).isNotNull())
        n = known({r["at"]: r["c"] for r in seen.filter("at >= 0").groupBy("at").agg(F.sum("c").alias("c")).collect()})
        values = seen.select(column).distinct().count()
        below = F.array(*[F.lit(x + SMOOTH * (values + 1)) for x in n])
        return cut(spread(column).filter(F.col(column).isNotNull()).select(F.col(column).alias(f"__{column}"), F.zip_with(
            "cs", below, lambda c, d: F.log((c + SMOOTH) / d)).alias(f"__of_{column}")))

    return hosts, given("said"), given("suffix"), F.array(*[F.log(F.lit(p)) for p in base]), zero


def identify(docs: DataFrame, model: Model, text: str = "text", declared: Column | None = None, host: Column | None = None,
             suffix: Column | None = None, into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: guess, posterior, accepted, n (trigrams).

    ``declared``, ``host`` and ``suffix`` are columns over ``docs``; one that is left out is null everywhere.
    """
    bounded_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    languages = [*model.languages, UNKNOWN]
    if not model.languages:
        return docs.withColumn(into, F.struct(F.lit(UNKNOWN).alias("guess"), F.lit(0.0).alias("posterior"),
                                              F.lit(False).alias("accepted"), F.lit(0).cast("bigint").alias("n")))
    host = none if host is None else host
    blocks = model.blocks()
    first = next(blocks)
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"),
                        (none if declared is None else declared).alias("said"), host.alias("host"),
                        domain_of(host).alias("domain"), (none if suffix is None else suffix).alias("suffix"),
                        text_evidence(first, text).alias("__text"))
    for block in blocks:
        # what the blocks before have found is written before the next one is gathered
        given = cut(given).withColumn("__now", text_evidence(block, f"__row.`{text}`"))
        given = given.withColumn("__text", F.struct(F.col("__text.n").alias("n"), F.concat(
            F.slice("__text.logs", F.lit(1), F.size("__text.logs") - 1), "__now.logs").alias("logs"))).drop("__now")
    logs = F.transform("__text.logs", lambda x: x / F.lit(TEMPER))
    read = given.select("said", "host", "domain", "suffix",
                        F.when(F.col("__text.n") > 0, _winner(F.col("__text.logs"), languages)).alias("guess"))
    hosts, said, suffixes, base, zero = _priors(read, languages)
    joined = given.join(hosts, F.col("host") == F.col("__host"), "left").join(said, F.col("said") == F.col("__said"), "left").join(
        suffixes, F.col("suffix") == F.col("__suffix"), "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(logs, F.coalesce("__prior", base)), add(F.coalesce("__of_said", zero), F.coalesce("__of_suffix", zero)))
    out = joined.select("__row", F.col("__text.n").alias("__n"), total.alias("__total"))
    best = F.array_max("__total")
    mass = F.aggregate("__total", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    guess = F.when(F.col("__n") > 0, _winner(F.col("__total"), languages)).otherwise(UNKNOWN)
    found = F.struct(guess.alias("guess"), (1.0 / mass).alias("posterior"),
                     ((guess != UNKNOWN) & (1.0 / mass >= MIN_POSTERIOR)).alias("accepted"), F.col("__n").alias("n"))
    return out.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != into], found.alias(into))


def accepted(docs: DataFrame, label: str = "lang", host: str | None = "source", text: str = "text") -> DataFrame:
    """The documents in a language, with their own columns: ``label`` trains and is declared, ``host`` is a prior."""
    model = fit(docs, text, label)
    found = identify(docs, model, text, declared=F.col(label), host=F.col(host) if host else None, into="__language")
    return found.filter("__language.accepted").select(*[F.col(f"`{c}`") for c in docs.columns])
