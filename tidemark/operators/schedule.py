"""Schedule ticks: fixed intervals and cron expressions, as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.values import duration_ms
from tidemark.model import NAMESPACE
from tidemark.operators import store as St, triggers as Tr

# Ticks made from one row at a time; longer runs are split before they are made.
TICKS_PER_ROW = 10_000

_MICROS = 1_000

# Names cron fields may use.
_MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]
_DAYS = ["SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"]


def expand_every(schedules: DataFrame, start: str = "start", end: str = "end", every_ms: str = "every_ms") -> DataFrame:
    """Ticks of ``every_ms`` from ``start`` (the first one at once) up to, not including, ``end``.

    Works on instants in microseconds (BIGINT columns) and adds ``n`` and ``at``. A
    schedule of any length is first cut into runs of bounded length, which are
    spread over the tasks before the ticks are made.
    """
    step = F.col(every_ms) * _MICROS
    total = F.ceil((F.col(end) - F.col(start)) / step).cast("bigint")
    # with a number, as the runs are tiny and adaptive execution would put them all in one task
    n = int(schedules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (
        schedules.filter((F.col(every_ms) > 0) & (F.col(end) > F.col(start)))
        .withColumn("__total", total)
        .withColumn("__from", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("__total") - 1, F.lit(TICKS_PER_ROW).cast("bigint"))))
        .repartition(n, "__from", start)
    )
    last = F.least(F.col("__from") + TICKS_PER_ROW, F.col("__total")) - 1
    ticks = runs.withColumn("n", F.explode(F.sequence(F.col("__from"), last)))
    return ticks.withColumn("at", F.col(start) + F.col("n") * step).drop("__total", "__from")


def cron_field(field: Column, low: int, high: int, names: list[str] = (), first: int = 0) -> Column:
    """Numbers a cron field allows: ``*``, ``a``, ``a-b``, ``*/n``, ``a-b/n``, ``a/n`` and lists of them."""
    text = F.upper(field)
    for i, name in enumerate(names):
        text = F.replace(text, F.lit(name), F.lit(str(i + first)))
    shape = r"^(\*|\d+)(?:-(\d+))?(?:/(\d+))?$"

    def allows(part: Column, x: Column) -> Column:
        a = F.regexp_extract(part, shape, 1)
        b = F.nullif(F.regexp_extract(part, shape, 2), F.lit(""))
        s = F.nullif(F.regexp_extract(part, shape, 3), F.lit(""))
        lo = F.when(a == "*", F.lit(low)).otherwise(F.nullif(a, F.lit("")).try_cast("int"))
        hi = (
            F.when(b.isNotNull(), b.cast("int"))
            .when((a == "*") | s.isNotNull(), F.lit(high)).otherwise(lo)
        )
        return x.between(lo, hi) & (F.pmod(x - lo, F.coalesce(s.cast("int"), F.lit(1))) == 0)

    return F.filter(
        F.sequence(F.lit(low), F.lit(high)),
        lambda x: F.exists(F.split(text, ","), lambda p: F.coalesce(allows(p, x), F.lit(False))))


def expand_cron(schedules: DataFrame, start: str = "start", end: str = "end", cron: str = "cron") -> DataFrame:
    """Minutes a five-field cron expression names in ``[start, end)``, as ``at`` (BIGINT microseconds).

    Days are made first and filtered on day and month, then hours, then minutes, so
    nothing is made that does not fire. As usual, when both the day of month and
    the day of week are restricted either of them is enough.
    """
    day_us, hour_us, minute_us = (
        F.lit(us).cast("bigint") for us in (86_400_000_000, 3_600_000_000, 60_000_000))
    day0 = F.floor(F.col(start) / day_us).cast("bigint")
    day1 = F.floor((F.col(end) - 1) / day_us).cast("bigint")
    # many schedules share few expressions: each is read once
    parts = F.split(F.trim(F.col(cron)), r"\s+")
    fields = F.struct(
        cron_field(parts[0], 0, 59).alias("minutes"),
        cron_field(parts[1], 0, 23).alias("hours"),
        cron_field(parts[2], 1, 31).alias("dom"),
        cron_field(parts[3], 1, 12, _MONTHS, 1).alias("months"),
        F.transform(cron_field(parts[4], 0, 7, _DAYS), lambda d: d % 7).alias("dow"),
        (parts[2] == "*").alias("any_dom"),
        (parts[4] == "*").alias("any_dow"),
    )
    # as a generator's output the fields stay where they are computed, before the join
    lines = schedules.select(cron).distinct().filter(F.size(parts) == 5).select(
        cron, F.explode_outer(F.array(fields)).alias("__c"))
    parsed = schedules.filter(F.col(end) > F.col(start)).join(lines, cron)
    days = parsed.withColumn("__day", F.explode(F.sequence(day0, day1)))
    date = F.date_from_unix_date(F.col("__day").cast("int"))
    in_dom = F.array_contains("__c.dom", F.dayofmonth(date))
    in_dow = F.array_contains("__c.dow", F.dayofweek(date) - 1)
    both = ~F.col("__c.any_dom") & ~F.col("__c.any_dow")
    days = days.filter(F.array_contains("__c.months", F.month(date))).filter(
        F.when(both, in_dom | in_dow).otherwise(in_dom & in_dow))
    hours = days.withColumn("__hour", F.explode("__c.hours"))
    ticks = hours.withColumn("__minute", F.explode("__c.minutes"))
    at = F.col("__day") * day_us + F.col("__hour") * hour_us + F.col("__minute") * minute_us
    return (
        ticks.withColumn("at", at)
        .filter((F.col("at") >= F.col(start)) & (F.col("at") < F.col(end)))
        .drop("__c", "__day", "__hour", "__minute")
    )


def schedule_windows(history: DataFrame, until: Column) -> DataFrame:
    """When each version's schedules are active: from its put to the id's next operation.

    Any put replaces the schedules of its document (one without a schedule just
    stops them) and a delete removes them, so a version's own interval is the answer.
    """
    return history.filter(F.col("op") == "put").withColumn(
        "end", F.coalesce(F.least("valid_to", until), until)).withColumnRenamed("valid_from", "start")


def _micros(ts: Column, zoneless: bool) -> Column:
    ts = ts.cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(ts, F.current_timezone()) if zoneless else ts)


def schedule_ticks(log: DataFrame, until: Column, namespace: str = NAMESPACE) -> DataFrame:
    """Ticks of the schedules that documents of a log carry: ``self_id, idx, tx_id, ts`` (microseconds), before ``until``.

    ``log`` has ``tx_id, tx_time, op, id, doc`` (VARIANT) and the optional columns of ``normalise_ops``.
    A schedule is ``{"every": ms}``, ``{"every": [n, unit]}`` or ``{"cron": line}``. It runs from its put to the
    next put or delete of its document; operations that do not count, such as a put that asks to be
    ignored, leave it running and start none. Specs without a readable time do not tick.
    """
    ops = St.normalise_ops(log)
    specs = Tr.triggers_of(ops, namespace).filter("on_k = 'schedule'").select("self_id", "idx", "spec", F.col("from_tx").alias("tx_id"))
    lives = schedule_windows(St.history(ops.select("id", "tx_id", "tx_time", "op")), until)
    zoneless = dict(lives.dtypes)["start"] == "timestamp_ntz"
    lives = lives.select(F.col("id").alias("self_id"), "tx_id", _micros(F.col("start"), zoneless).alias("start"),
                         _micros(F.col("end"), zoneless).alias("end"))
    at = lambda path: F.get_json_object("spec", path)
    timed = specs.join(lives, ["self_id", "tx_id"]).select(
        "self_id", "idx", "tx_id", "start", "end", at("$.cron").alias("cron"),
        duration_ms(F.coalesce(at("$.every[0]"), at("$.every")).try_cast("bigint"), at("$.every[1]")).alias("every_ms"))
    every = expand_every(timed.filter("every_ms is not null"))
    cron = expand_cron(timed.filter("cron is not null and every_ms is null"))
    names = ["self_id", "idx", "tx_id", F.col("at").alias("ts")]
    return every.select(*names).unionByName(cron.select(*names))
