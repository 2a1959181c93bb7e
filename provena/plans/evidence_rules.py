"""Queries on recorded evidence over the given tables: rows with drawn flaws, and DuckDB oracles written from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.operators import records, state
from provena.plans import tables as t
from provena.plans.tables import _digit, _one_of
from provena.shared import by_keys

FIRST = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
#: Details of the types in the made-up logs: A stands for a drawn count, T for a text, C for a code.
FORMS = {
    "run_started": '"suite":T,"tasks":A', "run_resumed": '"previous_status":T', "run_completed": '"operation":T,"tasks":A', "task_started": '"attempt":A', "task_failed": '"attempt":A,"return_code":C,"reason":T',
    "task_recovery_prepared": '"previous_status":T,"attempt":A,"quarantined_outputs":A', "task_completed": '"attempt":A,"outputs":A', "odd": "",
}


def _event_lines(spark, sf):
    e = t.read(spark, sf, "events", "event_id", "user_id")
    d = lambda place: _digit("event_id", place)
    e = e.withColumn("record", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    kind = _one_of(d(1), *FORMS)
    details = F.replace(F.replace(F.replace(_one_of(d(1), *FORMS.values()), F.lit(":A"), F.concat(F.lit(":"), _one_of(d(2), "-1", "null", '"1"', "true", "1.5", "1", "1", "1"))),
        F.lit(":T"), F.concat(F.lit(":"), _one_of(d(3), '""', "7", "null", '"x"', '"x"', '"x"', '"x"', '"x"'))), F.lit(":C"), F.concat(F.lit(":"), _one_of(d(4), "null", "-9", '"0"', "0")))
    more = F.when(d(5) == 0, F.when(details == "", '"more":1').otherwise(',"more":1')).otherwise("")
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat(
        F.lit('{"schema_version":'), _one_of(d(7), "2", '"1"', "1", "1", "1", "1", "1", "1"), F.lit(',"time":'), F.when(d(10) == 0, '""').otherwise('"t"'), F.lit(',"type":'), text(kind),
        F.lit(',"run_id":'), text(F.when(d(8) == 0, "x").otherwise(F.col("user_id").cast("string"))), F.lit(',"sequence":'), (F.col("record") + F.when(d(9) == 0, 1).otherwise(0)).cast("string"),
        F.lit(f',"previous_sha256":"{FIRST}","details":{{'), details, more, F.lit("}"), F.when(d(6) < 8, ',"task_id":"t1"').when(d(6) < 12, ',"task_id":"zz"').otherwise(""), F.when(d(11) == 0, ',"extra":0').otherwise(""), F.lit("}"),
    )
    e = e.withColumn("line", F.concat(F.when(d(12) == 0, "[1]").when(d(12) == 1, '{"a":1,"a":2}').otherwise(line), F.lit("\n")))
    # all lines name the prefix of the first one, but for half of the second ones, which name their own
    own = F.sha2(F.lag("line").over(Window.partitionBy("user_id").orderBy("event_id")), 256)
    return e.select("user_id", "record", F.when((F.col("record") == 2) & (d(13) < 8), F.replace("line", F.lit(FIRST), own)).otherwise(F.col("line")).alias("line"))


def event_rules(spark, sf):
    log = _event_lines(spark, sf)
    plans = log.select("user_id").distinct().select("user_id", F.lit(1).alias("schema_version"), F.array(F.lit("t1"), F.lit("t2")).alias("tasks"))
    return records.event_faults(log, "user_id", "record", "line", plans).select("user_id", "record", F.array_join("faults", ",").alias("faults"))


def termination_rules(spark, sf):
    o = t.read(spark, sf, "orders", "o_orderkey")
    d = _digit("o_orderkey", 1)
    body = ",".join(f'"{name}":"x"' for name in records.RESULT_FIELDS[1:])
    whole = F.concat(F.lit('{"action":'), F.when(d == 5, "1").when(d == 8, "null").otherwise('"start"'), F.lit(f",{body}"), F.when(d == 1, F.concat(F.lit(',"run_id2":"'), F.repeat(F.lit("x"), 1024), F.lit('"'))).when(d == 4, ',"more":"x"').when(d == 7, ',"outcome":"y"').otherwise(""), F.lit("}"), F.when(d == 6, " x").otherwise(""))
    message = F.when(d == 0, "").when(d == 2, "[]").when(d == 3, f"{{{body}}}").otherwise(whole)
    judged = o.select("o_orderkey", message.alias("message")).withColumn("fault", records.termination(F.col("message")))
    return judged.select("o_orderkey", "fault", records.termination_fields(F.col("message"), F.col("fault"))["action"].alias("action"))


def _plan_tasks(spark, sf):
    """Lines of an order as the tasks of a plan: each reads what a line before it makes, if drawn so also what a later one makes."""
    rows = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber").distinct().withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    d, n = (lambda place: _digit("k", place)), F.col("l_linenumber").cast("int")
    name = lambda number: F.concat(F.lit("o/"), number.cast("string"))
    return rows.select(
        F.col("l_orderkey").alias("run"), F.when(d(1) == 0, n).otherwise(n - 1).alias("ord"), F.when(d(2) == 0, F.lit("t1")).when(d(2) == 1, F.lit("a b")).otherwise(F.concat(F.lit("t"), n.cast("string"))).alias("id"),
        F.when(d(3) == 0, F.array().cast("array<string>")).when(d(3) == 1, F.array(F.repeat(F.lit("x"), 4097))).otherwise(F.array(F.lit("run"), F.col("k"))).alias("argv"),
        F.when(d(4) == 0, F.array(name(n + 1))).when(d(4) == 1, F.array(F.lit("../x"))).when(d(4) == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(name(n - 1))).alias("inputs"),
        F.when(d(5) == 0, F.array(name(F.lit(1)))).otherwise(F.array(name(n))).alias("outputs"),
    )


def plan_rules(spark, sf):
    return records.plan_faults(_plan_tasks(spark, sf), "run")


def path_references(spark, sf):
    return records.path_references(_plan_tasks(spark, sf), "run")


def quarantine_rules(spark, sf):
    from provena.functions import identity as I

    o = t.read(spark, sf, "orders", "o_orderkey", "o_custkey")
    d, h = (lambda place: _digit("o_orderkey", place)), F.sha2(F.col("o_orderkey").cast("string"), 256)
    source = F.when(d(1) == 0, "../x").when(d(1) == 1, "undeclared").otherwise("out")
    rows = o.select(F.col("o_custkey").alias("run"), F.concat(F.lit("t"), (F.col("o_orderkey") % 3).cast("string")).alias("task"), (F.col("o_orderkey") % 4).cast("int").alias("attempt"), source.alias("source"), F.when(d(3) == 0, "zz").otherwise(h).alias("sha256"), F.when(d(4) == 0, -1).otherwise(1).cast("long").alias("size"), d(2).alias("drawn"), "o_orderkey")
    artifact = F.when(F.col("drawn") == 0, F.concat(F.lit("quarantine/"), "sha256")).otherwise(F.concat(F.lit("quarantine/"), I.quarantine_name(F.col("task"), F.col("attempt"), F.col("source"))))
    rows = rows.withColumn("artifact", artifact).drop("drawn")
    outputs = rows.select("run", "task").distinct().withColumn("path", F.lit("out"))
    return records.quarantine_faults(rows, outputs).select("o_orderkey", F.array_join("faults", ",").alias("faults"))


def bundle_rules(spark, sf):
    o = t.read(spark, sf, "orders", "o_orderkey", "o_custkey")
    d, h = (lambda place: _digit("o_orderkey", place)), F.sha2(F.col("o_orderkey").cast("string"), 256)
    path = F.when(d(2) == 0, F.concat(F.lit("a//"), F.col("o_orderkey"))).when(d(2) < 4, "plan.json").otherwise(F.concat(F.lit("out/"), F.col("o_orderkey")))
    rows = o.select(F.col("o_custkey").alias("bundle"), _one_of(d(1), "plan", "state", "output", "output", "log", "artifact", "extra").alias("role"), path.alias("path"), F.when(d(3) == 0, F.upper(h)).otherwise(h).alias("sha256"), F.when(d(4) > 0, F.lit(5)).cast("long").alias("size"))
    return records.bundle_faults(rows, "bundle")


def avoided_work(spark, sf):
    a = t.attempts(spark, sf)
    resumed = a.filter("(done or flag <> 'N') and not (done and number % 2 = 0)")
    work = lambda rows: state.work(rows, "worker", "task", F.col("done"))
    return records.avoided_work(work(a), work(resumed), "worker")


def context_bindings(spark, sf):
    lines = t.read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag")
    lines = by_keys(lines, 2 * lines.count(), "l_orderkey", "l_linenumber").distinct()
    plans = lines.filter("l_linenumber > 1").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("mode")).withColumn("digest", records.context_sha("mode", "l_linenumber"))
    attempts = lines.select("l_orderkey", "l_linenumber", F.when(_digit("l_orderkey", 1) == 0, "PIPE").otherwise(F.col("l_returnflag")).alias("mode")).withColumn("digest", records.context_sha("mode", "l_linenumber")).distinct()
    return records.context_bindings(attempts, plans, ["l_orderkey", "l_linenumber"], "digest").select("l_orderkey", "l_linenumber", "digest")


def volatile_overlap(spark, sf):
    """Orders as paths, of which some lie below the path of their order or another one; some orders' own paths are immutable."""
    o = t.read(spark, sf, "orders", "o_orderkey").withColumn("own", F.concat(F.lit("w/"), F.col("o_orderkey").cast("string")))
    volatile = o.select(_one_of(_digit("o_orderkey", 1), F.col("own"), F.concat("own", F.lit("/log")), F.concat("own", F.lit("/a/b")), F.concat("own", F.lit("x")), F.concat(F.lit("w/"), F.right("own", F.lit(2)))).alias("path"))
    return records.volatile_overlap(volatile, o.filter(_digit("o_orderkey", 2) < 8).select(F.col("own").alias("path")))


def changed_between(spark, sf):
    first = t.read(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    second = first.filter(_digit("o_orderkey", 1) > 0).withColumn("o_orderstatus", F.when(_digit("o_orderkey", 2) == 0, "X").otherwise(F.col("o_orderstatus")))
    return records.unstable(first, second, ["o_orderkey"])


def summary_rules(spark, sf):
    a = t.read(spark, sf, "customer", "c_custkey", "c_nationkey").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("long").alias("v"))
    b = t.read(spark, sf, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") % 25).alias("v"))
    return records.summary_matches(a, b, "k", "v")


QUERIES = {f.__name__: f for f in (event_rules, termination_rules, plan_rules, path_references, quarantine_rules, bundle_rules, avoided_work, context_bindings, volatile_overlap, changed_between, summary_rules)}

_d, _pick = t.digit_sql, t.pick_sql
_USES = {mark: ", ".join(f"'{name}'" for name, form in FORMS.items() if f":{mark}" in form) for mark in "ATC"}
_TASKS = f"""k AS (SELECT DISTINCT l_orderkey AS run, l_linenumber AS n, md5(l_orderkey || '-' || l_linenumber) AS m, l_orderkey || '-' || l_linenumber AS name FROM lineitem),
  task AS (SELECT run, n, CASE WHEN {_d(1)} = 0 THEN n ELSE n - 1 END AS ord, CASE {_d(2)} WHEN 0 THEN 't1' WHEN 1 THEN 'a b' ELSE 't' || n END AS id, {_d(3)} AS argv, name,
    CASE {_d(4)} WHEN 0 THEN ['o/' || (n + 1)] WHEN 1 THEN ['../x'] WHEN 2 THEN ['a', 'a'] ELSE ['o/' || (n - 1)] END AS inputs, CASE WHEN {_d(5)} = 0 THEN 'o/1' ELSE 'o/' || n END AS output FROM k)"""
_BUNDLES = f"""b AS (SELECT o_custkey AS bundle, {_pick(1, "plan", "state", "output", "output", "log", "artifact", "extra")} AS role, CASE WHEN {_d(2)} = 0 THEN 'a//' || o_orderkey WHEN {_d(2)} < 4 THEN 'plan.json' ELSE 'out/' || o_orderkey END AS path,
    {_d(3)} = 0 OR {_d(4)} = 0 AS odd FROM (SELECT *, md5(o_orderkey::VARCHAR) AS m FROM orders))"""
_SHA = """sha256('{"l_linenumber":' || l_linenumber || ',"mode":"' || mode || '"}' || chr(10))"""
ORACLES = {
    "event_rules": f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS record, md5(event_id::VARCHAR) AS m FROM events), k AS (SELECT *, {_pick(1, *FORMS)} AS kind, {_d(12)} < 2 AS no_json FROM e)
        SELECT user_id, record, array_to_string([x FOR x IN [
          CASE WHEN no_json THEN 'json' END,
          CASE WHEN no_json OR {_d(11)} = 0 THEN 'fields' END,
          CASE WHEN no_json OR {_d(7)} % 8 < 2 THEN 'schema_version' END,
          CASE WHEN no_json OR {_d(8)} = 0 THEN 'run_id' END,
          CASE WHEN no_json OR {_d(9)} = 0 THEN 'sequence' END,
          CASE WHEN no_json OR record > 1 AND NOT (record = 2 AND {_d(13)} < 8) THEN 'previous_sha256' END,
          CASE WHEN no_json OR {_d(10)} = 0 THEN 'time' END,
          CASE WHEN no_json OR kind = 'odd' THEN 'type' END,
          CASE WHEN no_json OR CASE WHEN kind LIKE 'task%' THEN {_d(6)} >= 8 ELSE {_d(6)} < 12 END THEN 'task_id' END,
          CASE WHEN no_json OR kind = 'odd' OR {_d(5)} = 0 THEN 'details' END,
          CASE WHEN no_json OR kind = 'odd' OR kind IN ({_USES["A"]}) AND {_d(2)} % 8 < 5 OR kind IN ({_USES["T"]}) AND {_d(3)} % 8 < 3 OR kind IN ({_USES["C"]}) AND {_d(4)} % 4 = 2 THEN 'values' END] IF x IS NOT NULL], ',') AS faults FROM k""",
    "termination_rules": f"""SELECT o_orderkey, CASE d WHEN 0 THEN 'empty' WHEN 1 THEN 'too long' WHEN 2 THEN 'not one object' WHEN 6 THEN 'not one object' WHEN 7 THEN 'not one object' WHEN 3 THEN 'fields' WHEN 4 THEN 'fields' WHEN 5 THEN 'not a text' WHEN 8 THEN 'not a text' END AS fault,
        CASE WHEN d > 8 THEN 'start' END AS action FROM (SELECT o_orderkey, {_d(1, "md5(o_orderkey::VARCHAR)")} AS d FROM orders)""",
    "plan_rules": f"""WITH {_TASKS}, made AS (SELECT run, output, min(ord) AS producer, count(DISTINCT ord) AS n FROM task GROUP BY 1, 2), flat AS (SELECT run, id, ord, unnest(inputs) AS input FROM task)
        SELECT run, id AS task, 'id' AS rule FROM task WHERE id = 'a b' UNION ALL SELECT run, id, 'argv' FROM task WHERE argv < 2 UNION ALL SELECT run, id, 'paths' FROM task WHERE inputs[1] = '../x' UNION ALL SELECT run, id, 'path twice' FROM task WHERE len(inputs) = 2
        UNION ALL SELECT run, NULL, 'order' FROM task GROUP BY run HAVING count(DISTINCT ord) < count(*) OR min(ord) > 0 OR max(ord) <> count(*) - 1
        UNION ALL SELECT run, id, 'id twice' FROM task GROUP BY run, id HAVING count(*) > 1
        UNION ALL SELECT DISTINCT task.run, id, 'second producer' FROM task JOIN made ON made.run = task.run AND made.output = task.output WHERE made.n > 1
        UNION ALL SELECT DISTINCT flat.run, id, 'read before made' FROM flat JOIN made ON made.run = flat.run AND made.output = flat.input WHERE producer >= ord""",
    "path_references": f"""WITH {_TASKS} SELECT run, count(*) AS n_tasks, sum(len(inputs) + 1)::BIGINT AS n_references, count(*) AS n_outputs, sum(CASE argv WHEN 0 THEN 0 WHEN 1 THEN 4097 ELSE 3 + strlen(name) END)::BIGINT AS argument_bytes
        FROM task
        GROUP BY run""",
    "quarantine_rules": f"""WITH q AS (SELECT *, 't' || o_orderkey % 3 AS task, o_orderkey % 4 AS attempt, CASE {_d(1)} WHEN 0 THEN '../x' WHEN 1 THEN 'undeclared' ELSE 'out' END AS source, {_d(2)} = 0 AS other, CASE WHEN {_d(3)} = 0 THEN 'zz' ELSE o_orderkey::VARCHAR END AS sha, {_d(4)} = 0 AS negative
            FROM (SELECT o_orderkey, o_custkey, md5(o_orderkey::VARCHAR) AS m FROM orders)),
          n AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, task, attempt, source) AS sources, count(*) OVER (PARTITION BY o_custkey, task, attempt, CASE WHEN other THEN sha ELSE '/' || source END) AS artifacts FROM q)
        SELECT o_orderkey, array_to_string([x FOR x IN [CASE WHEN source = '../x' THEN 'source' END, CASE WHEN source <> 'out' THEN 'undeclared' END, CASE WHEN other THEN 'artifact' END, CASE WHEN sources > 1 OR artifacts > 1 THEN 'twice' END, CASE WHEN sha = 'zz' OR negative THEN 'identity' END] IF x IS NOT NULL], ',') AS faults FROM n""",
    "bundle_rules": f"""WITH {_BUNDLES} SELECT bundle, path, 'role' AS rule FROM b WHERE role = 'extra' UNION ALL SELECT bundle, path, 'path' FROM b WHERE path LIKE '%//%' UNION ALL SELECT bundle, path, 'identity' FROM b WHERE odd
        UNION ALL SELECT bundle, path, 'sealed twice' FROM b GROUP BY 1, 2 HAVING count(*) > 1
        UNION ALL SELECT bundle, NULL, 'not one plan' FROM b GROUP BY bundle HAVING count(*) FILTER (role = 'plan') <> 1 UNION ALL SELECT bundle, NULL, 'not one state' FROM b GROUP BY bundle HAVING count(*) FILTER (role = 'state') <> 1""",
    "avoided_work": """WITH a AS (SELECT l_suppkey AS worker, l_partkey AS task, count(*) AS c, count(*) FILTER (l_linestatus = 'F') AS g, count(*) FILTER ((l_linestatus = 'F' OR l_returnflag <> 'N') AND NOT again) AS c2,
          count(*) FILTER (l_linestatus = 'F' AND NOT again) AS g2 FROM (SELECT *, l_linestatus = 'F' AND l_linenumber % 2 = 0 AS again FROM lineitem) GROUP BY 1, 2)
        SELECT worker, (sum(c) - sum(c2))::BIGINT AS avoided_calls, (sum(greatest(0, g - 1)) - sum(greatest(0, g2 - 1)))::BIGINT AS avoided_duplicates FROM a GROUP BY worker HAVING sum(c2) > 0""",
    "context_bindings": f"""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), p AS (SELECT l_orderkey, l_linenumber, {_SHA} AS digest FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS mode FROM l WHERE l_linenumber > 1 GROUP BY 1, 2)),
          a AS (SELECT DISTINCT l_orderkey, l_linenumber, {_SHA} AS digest FROM (SELECT l_orderkey, l_linenumber, CASE WHEN {_d(1, "md5(l_orderkey::VARCHAR)")} = 0 THEN 'PIPE' ELSE l_returnflag END AS mode FROM l))
        SELECT a.* FROM a LEFT JOIN p USING (l_orderkey, l_linenumber) WHERE p.digest IS DISTINCT FROM a.digest""",
    "volatile_overlap": f"""WITH k AS (SELECT 'w/' || o_orderkey AS own, md5(o_orderkey::VARCHAR) AS m FROM orders), i AS (SELECT own FROM k WHERE {_d(2)} < 8),
          v AS (SELECT DISTINCT [own, own || '/log', own || '/a/b', own || 'x', 'w/' || right(own, 2)][{_d(1)} % 5 + 1] AS path FROM k)
        SELECT DISTINCT path FROM v JOIN i ON own = array_to_string(string_split(path, '/')[1:2], '/')""",
    "changed_between": f"SELECT o_orderkey FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders) WHERE {_d(1)} = 0 OR {_d(2)} = 0",
    "summary_rules": """WITH b AS (SELECT o_custkey AS k, count(*) % 25 AS v FROM orders GROUP BY 1) SELECT coalesce(c_custkey, k) AS k, CASE WHEN k IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'extra' WHEN c_nationkey = v THEN 'match' ELSE 'drift' END AS status FROM customer FULL JOIN b ON c_custkey = k""",
}
