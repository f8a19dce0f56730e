"""Triggers and schedules: what fires for the changes in the tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tidemark.model import FIRING_COLUMNS
from tidemark.operators import graph as G, queries as Q, schedule as Sc, standing as Sq, store as St, triggers as Tr
from tidemark.plans import inputs as I
from tidemark.plans.registry import register
from tidemark.session import cut

QUERIES: dict = {}
query = functools.partial(register, QUERIES)

_COLUMNS = ", ".join(FIRING_COLUMNS)


def _select(rank, kind, self_id="self_id", target="id", op_seq="op_seq", idx="idx", vector="is_vector"):
    return (f"tx_id, {rank} AS rank, {op_seq} AS op_seq, '{kind}' AS on_k, {self_id} AS self_id, {idx} AS idx, "
            f"'tide.on/{kind}' || CASE WHEN {vector} THEN '/' || {idx} ELSE '' END AS on_path, {target} AS target_id")


_BASE = f"{I.TX}, {I.DOCS}, {I.OPS}, {I.TRIG}"
_NULL = "CAST(NULL AS BIGINT)"
_SELF = lambda rank, kind: (
    f"SELECT {_select(rank, kind)} FROM ops JOIN trig ON id = self_id WHERE op = 'put' AND on_k = '{kind}'")
_SAVED = ("SELECT " + _select(2, "saved_query", "id", "replace(id, '.query.', '.query-out.')", idx="0", vector="false")
          + " FROM ops WHERE op = 'put' AND id LIKE '%query.tide.edn'")
_PATTERN = ("SELECT " + _select(5, "pattern", target="CASE WHEN op = 'put' THEN id END", idx="0", vector="false")
            + " FROM ops JOIN globs ON regexp_matches(id, regex)")
_TX = (f"SELECT {_select(8, 'tx', target='NULL', op_seq=_NULL)} FROM (SELECT DISTINCT tx_id FROM ops), trig "
       "WHERE on_k = 'tx'")
_REFS = (f"SELECT {_select(4, 'refs', target='changed.id')} FROM ops changed "
         "JOIN docs s ON s.id = changed.id JOIN closure ON node = s.doc_id JOIN docs d ON d.doc_id = owner "
         "JOIN trig ON self_id = d.id WHERE op = 'put' AND on_k = 'refs' AND from_tx <= tx_id")
# a one-entity query: users whose newest event is a purchase above 40
_QUERY_CHANGES = """ends AS (
  SELECT id, hour, CASE WHEN op = 'put' AND type = 'purchase' AND value > 40 THEN value END AS s FROM (
    SELECT *, epoch_us(tx_time) // 3600000000 - epoch_us(TIMESTAMP '2024-01-01') // 3600000000 AS hour,
      row_number() OVER (PARTITION BY id, epoch_us(tx_time) // 3600000000 ORDER BY tx_id DESC) AS rn FROM tx) WHERE rn = 1),
query_changes AS (SELECT DISTINCT hour AS tx_id FROM (
  SELECT *, lag(s) OVER (PARTITION BY id ORDER BY hour) AS before FROM ends) WHERE s IS DISTINCT FROM before)"""
_QUERY = ("SELECT " + _select(7, "query", "'/triggers/query-0'", "NULL", _NULL, "0", "false") + " FROM query_changes")


def _closure(spark, sf):
    owners = I.ref_owners(spark, sf).select(F.col("doc_id").alias("seed"))
    reached = G.forward_closure(owners, I.refs(spark, sf)).withColumnRenamed("seed", "owner")
    return I.doc_closure(spark, sf, reached)


def _query_changes(spark, sf, trig):
    log = I.tx(spark, sf).withColumn("hour", I.hour_of(F.col("tx_time")))
    wanted = (F.col("type") == "purchase") & (F.col("value") > 40)
    changes = Q.entity_query_changes(log, "hour", wanted, [F.col("value")])
    return Tr.each_with_all(
        changes, F.col("tx_id"), trig.filter(F.col("on_k") == "query").select("self_id", "idx"))


@query(f"WITH {_BASE} {_SELF(3, 'modify')}")
def trig_modify(spark, sf):
    return Tr.fire_self(I.ops(spark, sf), I.triggers(spark, sf), "modify")


@query(f"WITH {_BASE} {_PATTERN}")
def trig_pattern(spark, sf):
    return Tr.fire_pattern(I.ops(spark, sf), I.triggers(spark, sf))


@query(f"WITH RECURSIVE {_BASE}, {I.REFS}, {I.CLOSURE} {_REFS}")
def trig_refs(spark, sf):
    ops, trig = I.ops(spark, sf), I.triggers(spark, sf)
    return Tr.fire_refs(ops, trig, _closure(spark, sf))


@query(f"WITH {_BASE} {_TX}")
def trig_tx(spark, sf):
    return Tr.fire_tx(Tr.transactions(I.ops(spark, sf)), I.triggers(spark, sf))


@query(f"WITH {_BASE} {_SAVED}")
def trig_saved_query(spark, sf):
    return Tr.fire_saved_query(I.ops(spark, sf))


@query(f"WITH {_BASE}, {_QUERY_CHANGES} {_QUERY}")
def trig_query(spark, sf):
    trig = I.triggers(spark, sf)
    return Tr.fire_query(_query_changes(spark, sf, trig), trig)


def all_firings(spark, sf):
    ops, trig = I.ops(spark, sf), I.triggers(spark, sf)
    return Tr.compute_firings(
        ops, trig, _closure(spark, sf), _query_changes(spark, sf, trig))


_ALL = " UNION ALL ".join([_SAVED, _SELF(3, "modify"), _PATTERN, _SELF(6, "startup"), _TX, _REFS, _QUERY])
_ALL_WITH = f"WITH RECURSIVE {_BASE}, {_QUERY_CHANGES}, {I.REFS}, {I.CLOSURE}"


@query(f"{_ALL_WITH} {_ALL}")
def trig_firings(spark, sf):
    return all_firings(spark, sf)


@query(f"{_ALL_WITH} SELECT on_k, count(*) AS n FROM ({_ALL}) GROUP BY on_k")
def trig_frequencies(spark, sf):
    return Tr.frequencies(all_firings(spark, sf))


# documents of users as their events leave them: signups carry one trigger, purchases a vector of
# two and a glob, errors delete the document
_LOG_SPECS = """specs AS (
  SELECT id, tx_id, 'modify' AS on_k, 0 AS idx, false AS is_vector,
         '{"call":"note","params":[' || k || ']}' AS spec FROM tx WHERE op = 'put' AND type = 'signup'
  UNION ALL
  SELECT id, tx_id, 'modify', i, true, CASE i WHEN 0 THEN '"first"' ELSE '{"call":"second"}' END
  FROM tx, (VALUES (0), (1)) v(i) WHERE op = 'put' AND type = 'purchase'
  UNION ALL
  SELECT id, tx_id, 'pattern', 0, false, '{"call":"near","glob":"' || id || '?"}'
  FROM tx WHERE op = 'put' AND type = 'purchase'),
lives AS (SELECT specs.*, n.to_tx FROM specs JOIN (
  SELECT id, tx_id, lead(tx_id) OVER (PARTITION BY id ORDER BY tx_id) AS to_tx FROM tx) n USING (id, tx_id))"""


def _log_of_documents(spark, sf):
    t = I.tx(spark, sf)
    text = (
        F.when(F.col("type") == "signup", F.concat(
            F.lit('{"tide.on/modify": {"call": "note", "params": ['), F.col("k").cast("string"), F.lit("]}}")))
        .when(F.col("type") == "purchase", F.concat(
            F.lit('{"tide.on/modify": ["first", {"call": "second"}], "tide.on/pattern": {"call": "near", "glob": "'),
            F.col("id"), F.lit('?"}}')))
        .otherwise(F.lit('{"seen": true}')))
    return t.select("tx_id", F.col("tx_id").alias("op_seq"), "op", "id", F.when(
        F.col("op") == "put", F.parse_json(text)).alias("doc"))


@query(f"""WITH {I.TX}, {_LOG_SPECS}
SELECT id AS self_id, on_k, idx, is_vector, regexp_extract(spec, '"glob":"([^"]*)"', 1) AS glob, spec, tx_id AS from_tx, to_tx FROM lives""")
def trig_of_documents(spark, sf):
    """Triggers of all versions of the documents of a log."""
    found = Tr.triggers_of(_log_of_documents(spark, sf))
    return found.select("self_id", "on_k", "idx", "is_vector", F.coalesce("glob", F.lit("")).alias("glob"), "spec", "from_tx", "to_tx")


@query(f"""WITH {I.TX}, {_LOG_SPECS}
SELECT tx_id, 3 AS rank, tx_id AS op_seq, on_k, id AS self_id, idx,
  'tide.on/modify' || CASE WHEN is_vector THEN '/' || idx ELSE '' END AS on_path, id AS target_id, spec FROM lives WHERE on_k = 'modify'
UNION ALL
SELECT c.tx_id, 5, c.tx_id, on_k, l.id, idx, 'tide.on/pattern', CASE WHEN c.op = 'put' THEN c.id END, spec
FROM lives l JOIN tx c ON c.tx_id >= l.tx_id AND (l.to_tx IS NULL OR c.tx_id < l.to_tx) AND starts_with(c.id, l.id) AND length(c.id) = length(l.id) + 1
WHERE on_k = 'pattern'""")
def trig_firings_of_log(spark, sf):
    """Firings of the documents of a log through their whole life: triggers change and go with their documents."""
    log = _log_of_documents(spark, sf)
    ops = log.select("tx_id", "op_seq", "op", "id")
    return Tr.compute_firings(ops, Tr.triggers_of(log))


@query(f"""WITH {_BASE}, runs AS (SELECT DISTINCT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS tx_id FROM events)
SELECT tx_id, CASE on_k WHEN 'startup' THEN 6 ELSE 10 END AS rank, {_NULL} AS op_seq, on_k, self_id, idx,
  'tide.on/' || on_k AS on_path, self_id AS target_id
FROM runs, trig WHERE on_k IN ('startup', 'shutdown')""")
def lifecycle_firings(spark, sf):
    trig = I.triggers(spark, sf)
    runs = I.table(spark, sf, "events").select(
        F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("tx_id")).distinct()
    return Tr.fire_lifecycle(runs, trig, "startup").unionByName(Tr.fire_lifecycle(runs, trig, "shutdown"))


@query(f"""WITH {I.TX}, state AS (SELECT w.moment, tx.*, row_number() OVER (PARTITION BY w.moment, id ORDER BY tx_id DESC) AS rn
  FROM tx, (VALUES ('old', TIMESTAMP '{I.HALF}'), ('new', TIMESTAMP '{I.UNTIL}')) w(moment, t) WHERE tx_time <= t),
res AS (SELECT moment, id, type FROM state WHERE rn = 1 AND op = 'put' AND type <> 'view')
SELECT id, type, 'added' AS change, CAST(1 AS BIGINT) AS n FROM (SELECT id, type FROM res WHERE moment = 'new' EXCEPT ALL SELECT id, type FROM res WHERE moment = 'old')
UNION ALL
SELECT id, type, 'removed', 1 FROM (SELECT id, type FROM res WHERE moment = 'old' EXCEPT ALL SELECT id, type FROM res WHERE moment = 'new')""")
def trig_query_changes(spark, sf):
    t = I.tx(spark, sf).select("tx_id", "tx_time", "op", "id", "type")
    result = lambda at: St.as_of(t, time=I.ntz(at)).filter(F.col("type") != "view").select("id", "type")
    return Q.result_changes(result(I.HALF), result(I.UNTIL)).withColumn("n", F.col("n").cast("bigint"))


# a version's schedule comes from its own data: signups tick, purchases carry a cron line
_WINDOWS = f"""{I.TX}, h AS (SELECT *, lead(tx_time) OVER (PARTITION BY id ORDER BY tx_id) AS next FROM tx),
win AS (SELECT id, tx_id, type, k, tx_time AS t0, coalesce(least(next, TIMESTAMP '{I.UNTIL}'), TIMESTAMP '{I.UNTIL}') AS t1
  FROM h WHERE op = 'put')"""


def _windows(spark, sf, kind):
    t = I.tx(spark, sf).select("tx_id", "tx_time", "op", "id", "type", "k")
    w = Sc.schedule_windows(St.history(t), I.ntz(I.UNTIL)).filter(F.col("type") == kind)
    return w.withColumn("start", I.micros(F.col("start"))).withColumn("end", I.micros(F.col("end")))


@query(f"""WITH {_WINDOWS} SELECT id, tx_id, n, epoch_us(t0) + n * k * 60000000 AS "at"
FROM (SELECT *, unnest(generate_series(0, CAST(ceil((epoch_us(t1) - epoch_us(t0)) / (k * 60000000.0)) AS BIGINT) - 1)) AS n
  FROM win WHERE type = 'signup' AND k > 0 AND t1 > t0)""")
def schedule_every(spark, sf):
    from tidemark.functions.values import duration_ms

    w = _windows(spark, sf, "signup").withColumn("every_ms", duration_ms(F.col("k"), F.lit(":minutes")))
    return Sc.expand_every(w).select("id", "tx_id", "n", "at")


@query(f"""WITH {_WINDOWS}, hours AS (
  SELECT *, unnest(generate_series(date_trunc('hour', t0), t1, INTERVAL 1 HOUR)) AS h FROM win WHERE type = 'purchase')
SELECT id, tx_id, epoch_us(h) + (k % 60) * 60000000 AS "at" FROM hours
WHERE hour(h) % 6 = 0 AND dayofweek(h) BETWEEN 1 AND 5
  AND epoch_us(h) + (k % 60) * 60000000 >= epoch_us(t0) AND epoch_us(h) + (k % 60) * 60000000 < epoch_us(t1)""")
def schedule_cron(spark, sf):
    line = F.concat((F.col("k") % 60).cast("string"), F.lit(" */6 * * MON-FRI"))
    w = _windows(spark, sf, "purchase").withColumn("cron", line)
    return Sc.expand_cron(w).select("id", "tx_id", "at")


# documents that carry schedules: every k hours, or two in a vector; some views ask to be ignored and change none
@query(f"""WITH {I.TX}, counted AS (SELECT * FROM tx WHERE NOT (op = 'put' AND type = 'view' AND k % 3 = 0)),
h AS (SELECT *, lead(tx_time) OVER (PARTITION BY id ORDER BY tx_id) AS next FROM counted),
win AS (SELECT id, tx_id, type, k, epoch_us(tx_time) AS t0, epoch_us(coalesce(least(next, TIMESTAMP '{I.UNTIL}'), TIMESTAMP '{I.UNTIL}')) AS t1
  FROM h WHERE op = 'put'),
every AS (
  SELECT id, tx_id, 0 AS idx, t0, t1, k * 3600000000 AS step, 'tide.on/schedule' AS on_path,
    '{{"call":"tick","every":[' || k || ',"hours"]}}' AS spec FROM win WHERE type = 'signup' AND k > 0 AND t1 > t0
  UNION ALL
  SELECT id, tx_id, 1, t0, t1, 86400000000, 'tide.on/schedule/1', '{{"call":"daily","every":86400000}}' FROM win WHERE type = 'purchase' AND t1 > t0),
hours AS (SELECT *, unnest(generate_series(t0 - t0 % 3600000000, t1, 3600000000)) AS hr FROM win WHERE type = 'purchase'),
cron AS (SELECT *, hr + (k % 60) * 60000000 AS ts FROM hours WHERE hour(make_timestamp(hr)) % 6 = 0 AND dayofweek(make_timestamp(hr)) BETWEEN 1 AND 5)
SELECT tx_id, 9 AS rank, id AS self_id, idx, on_path, spec, t0 + n * step AS ts
FROM (SELECT *, unnest(generate_series(0, CAST(ceil((t1 - t0) / (step * 1.0)) AS BIGINT) - 1)) AS n FROM every)
UNION ALL
SELECT tx_id, 9, id, 0, 'tide.on/schedule/0', '{{"call":"note","cron":"' || k % 60 || ' */6 * * MON-FRI"}}', ts
FROM cron WHERE ts >= t0 AND ts < t1""")
def trig_schedule(spark, sf):
    """Firings of the schedules in the documents of a log."""
    t = I.tx(spark, sf)
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("type") == "signup", F.concat(F.lit('{"tide.on/schedule": {"every": ['), k, F.lit(', "hours"], "call": "tick"}}')))
        .when(F.col("type") == "purchase", F.concat(F.lit('{"tide.on/schedule": [{"cron": "'), (F.col("k") % 60).cast("string"), F.lit(
            ' */6 * * MON-FRI", "call": "note"}, {"every": 86400000, "call": "daily"}]}')))
        .otherwise(F.lit('{"seen": true}')))
    put = F.col("op") == "put"
    log = t.select("tx_id", "tx_time", "op", "id", F.when(put, F.parse_json(text)).alias("doc"),
                   (put & (F.col("type") == "view") & (F.col("k") % 3 == 0)).alias("ignore"))
    ticks = Sc.schedule_ticks(log, I.ntz(I.UNTIL))
    fired = Tr.fire_schedule(ticks, Tr.triggers_of(St.normalise_ops(log)))
    return fired.select("tx_id", "rank", "self_id", "idx", "on_path", "spec", "ts")


@query(f"""WITH {_BASE} {_SELF(3, 'modify')} UNION ALL {_PATTERN} UNION ALL {_TX} UNION ALL {_SELF(6, 'startup')}
UNION ALL {_SAVED}""".replace("FROM ops", "FROM user_ops").replace(f"WITH {_BASE}", f"""WITH {_BASE}, user_ops AS (
  SELECT ops.* FROM ops WHERE id LIKE '/users/%')"""))
def stream_firings(spark, sf):
    from tidemark.streaming.firings import firings_of_stream

    return firings_of_stream(spark, sf)


# users refer to lower users by what their newest event is; every fifth has a trigger on what it refers to
_IN_TIME = f"""lives AS (
  SELECT CAST(replace(id, '/users/', '') AS BIGINT) AS u, op, type, k, tx_id AS f,
         coalesce(lead(tx_id) OVER (PARTITION BY id ORDER BY tx_id), {G.FOREVER}) AS t FROM tx),
held AS (
  SELECT u AS src, u // 2 AS dst, f, t FROM lives WHERE op = 'put' AND u > 0 AND type IN ('purchase', 'view')
  UNION
  SELECT u, u // 3, f, t FROM lives WHERE op = 'put' AND u > 0 AND type = 'view'
  UNION
  SELECT u, u - 1 - k % 3, f, t FROM lives WHERE op = 'put' AND u > k % 3 AND type = 'signup'),
reached(owner, node, f, t) AS (
  SELECT src, dst, f, t FROM held WHERE src % 5 = 3
  UNION
  SELECT c.owner, e.dst, greatest(c.f, e.f), least(c.t, e.t) FROM reached c JOIN held e ON e.src = c.node
  WHERE greatest(c.f, e.f) < least(c.t, e.t)),
fired AS (SELECT DISTINCT tx_id, '/users/' || owner AS self_id, id FROM tx
  JOIN reached ON id = '/users/' || node AND f <= tx_id AND tx_id < t WHERE op = 'put')"""


@query(f"WITH RECURSIVE {I.TX}, {_IN_TIME} SELECT {_select(4, 'refs', op_seq='tx_id', idx='0', vector='false')} FROM fired")
def trig_refs_as_of(spark, sf):
    """Firings on references as they were after each transaction."""
    log = I.tx(spark, sf).withColumn("u", F.substring_index("id", "/", -1).cast("bigint"))
    user = lambda n: F.concat(F.lit("/users/"), n.cast("bigint").cast("string"))
    half, third, near = F.floor(F.col("u") / 2), F.floor(F.col("u") / 3), F.col("u") - 1 - F.col("k") % 3
    refs = F.when(F.col("u") > 0, F.when(F.col("type") == "purchase", F.array(user(half))).when(
        F.col("type") == "view", F.array(user(half), user(third))).when(
        (F.col("type") == "signup") & (near >= 0), F.array(user(near))))
    owners = log.filter(F.col("u") % 5 == 3).select(F.col("id").alias("seed")).distinct()
    # who reaches a changed document: the owner is the node, the document the seed
    closure = G.closure_in_time(owners, G.edges_in_time(log, refs)).select(
        F.col("node").alias("seed"), F.col("seed").alias("node"), "from_tx", "to_tx")
    none = F.lit(None).cast("bigint")
    triggers = owners.select(F.col("seed").alias("self_id"), F.lit("refs").alias("on_k"), F.lit(0).alias("idx"),
                             F.lit(False).alias("is_vector"), none.alias("from_tx"), none.alias("to_tx"))
    return Tr.fire_refs(log.withColumn("op_seq", F.col("tx_id")), triggers, closure)


# a query of each customer's own; a third of them ask another one later, some store without calling, some name themselves as path
_STANDING = f"""asks AS (
  SELECT c_custkey AS c, v, (c_custkey * 7 + v * 500) % (SELECT count(*) FROM events) AS from_tx, c_custkey + v * 11 AS s
  FROM customer, (VALUES (0), (1)) w(v) WHERE v = 0 OR c_custkey % 3 = 0),
standing AS (
  SELECT c, s, '/triggers/q' || c || '.md' AS self_id, from_tx, lead(from_tx) OVER (PARTITION BY c ORDER BY from_tx) AS to_tx,
         c % 13 = 5 AS own_path, c % 5 <> 4 AS has_call FROM asks),
versions AS (
  SELECT id, type, value, k, tx_id AS f, lead(tx_id) OVER (PARTITION BY id ORDER BY tx_id) AS t, op FROM tx),
matched AS (
  SELECT s.c, s.from_tx, f, t, md5(CASE s % 3 WHEN 0 THEN '"' || id || '"' || chr(31) || k WHEN 1 THEN '"' || type || '"' ELSE '"' || id || '"' END) AS d
  FROM standing s JOIN versions ON op = 'put' AND CASE s % 4
    WHEN 0 THEN type = ['purchase', 'signup', 'view', 'click'][1 + s % 3] AND value > s % 97
    WHEN 1 THEN k = s % 100
    WHEN 2 THEN value >= s % 211 AND value < s % 211 + 3 AND type <> 'view'
    ELSE type < 's' AND k <= s % 7 END),
steps AS (
  SELECT c, from_tx AS v, tx_id, sum(n) AS n, sum(n * a) AS a, sum(n * b) AS b FROM (
    SELECT c, from_tx, f AS tx_id, 1 AS n, ('0x' || substr(d, 1, 15))::HUGEINT AS a, ('0x' || substr(d, 16, 15))::HUGEINT AS b FROM matched
    UNION ALL
    SELECT c, from_tx, t, -1, ('0x' || substr(d, 1, 15))::HUGEINT, ('0x' || substr(d, 16, 15))::HUGEINT FROM matched WHERE t IS NOT NULL)
  GROUP BY ALL),
sums AS (
  SELECT c, v, tx_id, sum(n) OVER w AS n, sum(a) OVER w AS a, sum(b) OVER w AS b FROM steps WINDOW w AS (PARTITION BY c, v ORDER BY tx_id)),
seen AS (
  SELECT c, from_tx AS tx_id, coalesce(n, 0) AS n, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM (
    SELECT s.c, s.from_tx, max_by(n, x.tx_id) AS n, max_by(a, x.tx_id) AS a, max_by(b, x.tx_id) AS b
    FROM standing s LEFT JOIN sums x ON x.c = s.c AND x.v = s.from_tx AND x.tx_id <= s.from_tx GROUP BY ALL)
  UNION ALL
  SELECT s.c, x.tx_id, n, a, b FROM standing s JOIN sums x ON x.c = s.c AND x.v = s.from_tx AND x.tx_id > s.from_tx AND (s.to_tx IS NULL OR x.tx_id < s.to_tx)),
stored AS (
  SELECT * FROM (SELECT *, md5(n || ':' || a || ':' || b) AS results_hash, lag(md5(n || ':' || a || ':' || b)) OVER (PARTITION BY c ORDER BY tx_id) AS before FROM seen)
  WHERE results_hash IS DISTINCT FROM before AND c % 13 <> 5)"""


def _standing(spark, sf):
    """Users' events and customers' query documents as one log of documents, and the queries of it."""
    t = I.tx(spark, sf)
    n = I.table(spark, sf, "events").agg(F.count("*")).scalar()
    events = t.select("tx_id", F.col("tx_id").alias("op_seq"), "op", "id", F.when(
        F.col("op") == "put", F.parse_json(F.to_json(F.struct("type", "value", "k")))).alias("doc"))
    c, s = F.col("c_custkey"), F.col("s")
    asks = I.table(spark, sf, "customer").select(c, F.explode(F.when(c % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("v"))
    asks = asks.withColumn("s", c + F.col("v") * 11)
    text = lambda x: x.cast("string")
    kind = F.get(F.array(*[F.lit(x) for x in ("purchase", "signup", "view", "click")]), (s % 3).cast("int"))
    where = (F.when(s % 4 == 0, F.concat(F.lit('["type","'), kind, F.lit('"],["value",">",'), text(s % 97), F.lit("]")))
             .when(s % 4 == 1, F.concat(F.lit('["k",'), text(s % 100), F.lit("]")))
             .when(s % 4 == 2, F.concat(F.lit('["value",">=",'), text(s % 211), F.lit('],["value","<",'), text(s % 211 + 3), F.lit('],["type","!=","view"]')))
             .otherwise(F.concat(F.lit('["type","<","s"],["k","<=",'), text(s % 7), F.lit("]"))))
    show = F.when(s % 3 == 0, '["id","k"]').when(s % 3 == 1, '["type"]').otherwise('["id"]')
    path = F.concat(F.when(c % 13 == 5, F.concat(F.lit("q"), text(c), F.lit(".md"))).otherwise(F.concat(F.lit("q"), text(c), F.lit(".edn"))))
    call = F.when(c % 5 != 4, ',"call":"note"').otherwise("")
    doc = F.concat(F.lit('{"tide.on/query":{"where":['), where, F.lit('],"show":'), show, F.lit(',"path":"'), path, F.lit('"'), call, F.lit("}}"))
    at = (c * 7 + F.col("v") * 500) % n
    asked = asks.select(at.cast("bigint").alias("tx_id"), (at + n).cast("bigint").alias("op_seq"), F.lit("put").alias("op"),
                        F.concat(F.lit("/triggers/q"), text(c), F.lit(".md")).alias("id"), F.parse_json(doc).alias("doc"))
    log = events.unionByName(asked)
    triggers = cut(Tr.triggers_of(log))
    return log, triggers, Sq.queries_of(triggers)


@query(f"""WITH {I.TX}, {_STANDING} SELECT tx_id, '/triggers/q' || c || '.md' AS self_id, 0 AS idx,
  '/triggers/q' || c || '.edn' AS results_path, CAST(n AS BIGINT) AS n, results_hash, c % 5 <> 4 AS has_call FROM stored""")
def standing_results(spark, sf):
    """What many different standing queries store, and after which transaction."""
    log, _, queries = _standing(spark, sf)
    return Sq.stored_results(log, queries)


@query(f"""WITH {I.TX}, {_STANDING} SELECT {_select(7, 'query', "'/triggers/q' || c || '.md'", 'NULL', _NULL, '0', 'false')}, results_hash
FROM stored WHERE c % 5 <> 4""")
def trig_standing(spark, sf):
    """Firings of standing queries: those with a call, when their results changed."""
    log, triggers, queries = _standing(spark, sf)
    return Tr.fire_query(Sq.stored_results(log, queries), triggers).drop("spec")


# the same documents with a day as transaction; a user's last event of a day counts
_BY_DAY = I.TX.replace("tx AS (", "single AS (", 1) + """, tx AS (
  SELECT date_diff('day', DATE '2024-01-01', CAST(tx_time AS DATE)) AS tx_id, tx_id AS op_seq, op, id, type, value, k FROM single
  QUALIFY row_number() OVER (PARTITION BY id, CAST(tx_time AS DATE) ORDER BY single.tx_id DESC) = 1)"""


@query(f"""WITH {_BY_DAY}, {_LOG_SPECS}
SELECT l.tx_id, 3 AS rank, c.op_seq, on_k, l.id AS self_id, idx,
  'tide.on/modify' || CASE WHEN is_vector THEN '/' || idx ELSE '' END AS on_path, l.id AS target_id, spec
FROM lives l JOIN tx c ON c.id = l.id AND c.tx_id = l.tx_id WHERE on_k = 'modify'
UNION ALL
SELECT c.tx_id, 5, c.op_seq, on_k, l.id, idx, 'tide.on/pattern', CASE WHEN c.op = 'put' THEN c.id END, spec
FROM lives l JOIN tx c ON c.tx_id >= l.tx_id AND (l.to_tx IS NULL OR c.tx_id < l.to_tx) AND starts_with(c.id, l.id) AND length(c.id) = length(l.id) + 1
WHERE on_k = 'pattern'""")
def stream_log_firings(spark, sf):
    """A log of a transaction a day, appended, streamed a week at a time and read back."""
    from tidemark.session import scratch
    from tidemark.streaming.firings import start_log_firings

    day = F.datediff(F.to_date("tx_time"), F.lit("2024-01-01").cast("date")).cast("bigint")
    docs = _log_of_documents(spark, sf).join(I.tx(spark, sf).select("tx_id", "tx_time"), "tx_id").withColumn("tx_id", day)
    last = docs.groupBy("id", "tx_id").agg(F.max("op_seq").alias("op_seq"))
    log = scratch(spark, "log")
    St.append_log(docs.join(last, ["id", "tx_id", "op_seq"], "left_semi"), log)
    out = scratch(spark, "firings")
    start_log_firings(spark, log, out, scratch(spark, "offsets"), transactions_at_once=7).awaitTermination()
    return spark.read.schema("rank int, op_seq long, on_k string, self_id string, idx int, on_path string, target_id string, spec string, tx_id long").parquet(out)
