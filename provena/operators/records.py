"""Rules of recorded evidence: event records, plans, quarantine records, bundles, step results, locks, contexts.

Each validator returns names of broken rules, as an array per row or as (key, rule) rows; nothing is dropped in silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import identity as I
from provena.functions import paths as P
from provena.operators import eventlog
from provena.shared import by_keys

#: The details of each type of event; a text, a count, or a code, which may be negative or null.
DETAILS = {
    "run_started": {"suite": "text", "tasks": "count"},
    "run_resumed": {"previous_status": "text"},
    "run_completed": {"operation": "text", "tasks": "count"},
    "task_started": {"attempt": "count"},
    "task_failed": {"attempt": "count", "return_code": "code", "reason": "text"},
    "task_recovery_prepared": {"previous_status": "text", "attempt": "count", "quarantined_outputs": "count"},
    "task_completed": {"attempt": "count", "outputs": "count"},
}
#: Fields of an event, of which task_id stands in those of tasks only; limits.
EVENT_FIELDS, TASK_FIELD, MAX_TEXT = ("details", "previous_sha256", "run_id", "schema_version", "sequence", "time", "type"), "task_id", 8192
RESULT_FIELDS, MAX_RESULT = ("action", "agent_run_uid", "bundle_sha256", "error_code", "execution_spec_sha256", "outcome", "protocol", "resume_decision_sha256", "run_id"), 1024
MAX_TASKS, MAX_ARGS, MAX_ARG, MAX_ARG_BYTES, MAX_PATHS = 64, 128, 4096, 64 * 1024, 64


def _broken(rules: dict[str, Column]) -> Column:
    """The names of rules that are broken, or that cannot be judged."""
    return F.filter(F.array(*[F.when(F.coalesce(rule, F.lit(True)), name) for name, rule in rules.items()]), lambda x: x.isNotNull())


def strict_json(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing more; null for others. The parser stops behind the first value, so the text must also be
    one inside of brackets and of braces."""
    whole = F.try_parse_json(text)
    return F.when(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull(), whole)


def _kind(value: Column, path: str) -> Column:
    """The type of a field of a JSON value: BIGINT, STRING, OBJECT..., VOID for null; null if it is not there."""
    return F.schema_of_variant(F.variant_get(value, path, "variant"))


def _fits(value: Column, name: str, form: str) -> Column:
    kind, path = _kind(value, f"$.details.{name}"), f"$.details.{name}"
    if form == "text":
        text = F.try_variant_get(value, path, "string")
        return (kind == "STRING") & (text != "") & (F.char_length(text) <= MAX_TEXT)
    if form == "code":
        return kind.isin("BIGINT", "VOID")
    return (kind == "BIGINT") & (F.try_variant_get(value, path, "bigint") >= 0)


def event_faults(log: DataFrame, run: str, record: str, line: str, plans: DataFrame) -> DataFrame:
    """Per record of the logs (run, record number from 1, line with its newline) the rules it breaks: faults.

    ``plans`` has run, schema_version and tasks (an array of ids) of each run once; a run without a plan breaks what a plan would tell."""
    chained = log.join(eventlog.chain(log, run, record, line), [run, record]).join(plans.select(run, F.col("schema_version").alias("_version"), F.col("tasks").alias("_tasks")), run, "left")
    body = F.col(line)
    rows = chained.withColumn("_value", strict_json(body)).withColumn("_keys", F.when(F.col("_value").isNotNull(), F.map_keys(F.from_json(body, "map<string,string>"))))
    rows = rows.withColumn("_detail_keys", F.map_keys(F.from_json(F.to_json(F.variant_get("_value", "$.details", "variant")), "map<string,string>")))
    v = F.col("_value")
    text = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    number = lambda name: F.when(_kind(v, f"$.{name}") == "BIGINT", F.try_variant_get(v, f"$.{name}", "bigint"))
    of_task, known = text("type").startswith("task_"), text("type").isin(*DETAILS)
    detail_keys, fits = F.lit(False), F.lit(False)
    for kind, fields in DETAILS.items():
        own = text("type") == kind
        detail_keys = F.when(own, F.array_sort("_detail_keys") == F.array(*map(F.lit, sorted(fields)))).otherwise(detail_keys)
        every = F.lit(True)
        for name, form in fields.items():
            every = every & F.coalesce(_fits(v, name, form), F.lit(False))
        fits = F.when(own, every).otherwise(fits)
    named = text(TASK_FIELD).isNotNull() & F.coalesce(F.array_contains("_tasks", text(TASK_FIELD)), F.lit(False))
    rules = {
        "json": v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"),
        "fields": F.array_sort(F.array_except("_keys", F.array(F.lit(TASK_FIELD)))) != F.array(*map(F.lit, EVENT_FIELDS)),
        "schema_version": number("schema_version") != F.col("_version"),
        "run_id": text("run_id") != F.col(run).cast("string"),
        "sequence": number("sequence") != F.col(record),
        "previous_sha256": text("previous_sha256") != F.col("previous_sha256"),
        "time": F.coalesce(text("time"), F.lit("")) == "",
        "type": ~known,
        "task_id": F.when(of_task, ~named).otherwise(F.array_contains("_keys", F.lit(TASK_FIELD))),
        "details": ~detail_keys,
        "values": ~fits,
        "size": F.octet_length(body) > eventlog.MAX_EVENT_BYTES,
    }
    return rows.select(run, record, _broken(rules).alias("faults"))


def termination(message: Column) -> Column:
    """What is wrong with a termination message, which is one JSON object of exactly the nine texts, or null."""
    value = strict_json(message)
    keys = F.array_sort(F.map_keys(F.from_json(message, "map<string,string>")))
    every = F.schema_of_variant(value) == f"OBJECT<{', '.join(f'{name}: STRING' for name in sorted(RESULT_FIELDS))}>"
    return (
        F.when(F.coalesce(message, F.lit("")) == "", "empty").when(F.octet_length(message) > MAX_RESULT, "too long").when(value.isNull() | ~F.schema_of_variant(value).startswith("OBJECT"), "not one object")
        .when(keys != F.array(*map(F.lit, RESULT_FIELDS)), "fields").when(~every, "not a text")
    )


def termination_fields(message: Column, fault: Column | None = None) -> Column:
    """The nine fields of a message as a struct; null for a message with a fault, which may be known."""
    return F.when((termination(message) if fault is None else fault).isNull(), F.from_json(message, ", ".join(f"{name} string" for name in RESULT_FIELDS)))


def plan_faults(tasks: DataFrame, run: str) -> DataFrame:
    """(run, task, rule) for the tasks of plans: run, ord (from 0), id, argv, inputs, outputs; task is null for rules of a plan as a whole."""
    c = F.col
    portable = lambda name: F.forall(name, P.portable)
    own = {
        "id": ~c("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"),
        "argv": ~F.size("argv").between(1, MAX_ARGS) | F.exists("argv", lambda x: (F.octet_length(x) > MAX_ARG) | x.contains("\x00")) | (F.aggregate("argv", F.lit(0), lambda n, x: n + F.octet_length(x)) > MAX_ARG_BYTES),
        "paths": ~portable("inputs") | ~portable("outputs"),
        "too many paths": (F.size("inputs") > MAX_PATHS) | (F.size("outputs") > MAX_PATHS),
        "path twice": (F.size(F.array_distinct("inputs")) < F.size("inputs")) | (F.size(F.array_distinct("outputs")) < F.size("outputs")),
    }
    row = tasks.select(run, c("id").alias("task"), F.explode(_broken(own)).alias("rule"))
    whole = tasks.groupBy(run).agg(F.count("*").alias("n"), F.countDistinct("ord").alias("d"), F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    order = whole.filter((c("n") != c("d")) | (c("lo") != 0) | (c("hi") != c("n") - 1) | (c("n") > MAX_TASKS)).select(run, F.lit(None).cast("string").alias("task"), F.lit("order").alias("rule"))
    twice = tasks.groupBy(run, "id").count().filter("count > 1").select(run, c("id").alias("task"), F.lit("id twice").alias("rule"))
    made = tasks.select(run, "ord", F.explode("outputs").alias("path")).groupBy(run, "path").agg(F.min("ord").alias("producer"), F.countDistinct("ord").alias("n"))
    doubled = tasks.select(run, c("id").alias("task"), F.explode("outputs").alias("path")).join(made.filter("n > 1"), [run, "path"]).select(run, "task", F.lit("second producer").alias("rule")).distinct()
    read = tasks.select(run, c("id").alias("task"), "ord", F.explode("inputs").alias("path"))
    early = read.join(made, [run, "path"]).filter(c("producer") >= c("ord")).select(run, "task", F.lit("read before made").alias("rule")).distinct()
    return row.unionByName(order).unionByName(twice).unionByName(doubled).unionByName(early)


def path_references(tasks: DataFrame, run: str) -> DataFrame:
    """Per plan: tasks, references to paths, declared outputs and bytes of arguments."""
    size = F.aggregate("argv", F.lit(0), lambda n, x: n + F.octet_length(x))
    return tasks.groupBy(run).agg(F.count("*").alias("n_tasks"), F.sum(F.size("inputs") + F.size("outputs")).alias("n_references"), F.sum(F.size("outputs")).alias("n_outputs"), F.sum(size).alias("argument_bytes"))


def quarantine_faults(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """``records`` (run, task, attempt, source, artifact, sha256, size) with the rules each breaks; ``outputs`` (run, task, path) are declared."""
    declared = outputs.select("run", "task", F.col("path").alias("source"), F.lit(True).alias("_declared")).distinct()
    key = ["run", "task", "attempt"]
    twice = records.groupBy(*key, "source").agg(F.count("*").alias("_sources"))
    again = records.groupBy(*key, "artifact").agg(F.count("*").alias("_artifacts"))
    rows = records.join(declared, ["run", "task", "source"], "left").join(twice, [*key, "source"]).join(again, [*key, "artifact"])
    expected = F.concat(F.lit("quarantine/"), I.quarantine_name(F.col("task").cast("string"), F.col("attempt"), F.col("source")))
    rules = {
        "source": ~P.portable(F.col("source")), "undeclared": F.col("_declared").isNull(), "artifact": F.col("artifact") != expected,
        "twice": (F.col("_sources") > 1) | (F.col("_artifacts") > 1), "identity": ~I.valid_identity(F.col("sha256"), F.col("size")),
    }
    return rows.select(*records.columns, _broken(rules).alias("faults"))


#: Roles that rows of sealed things may have where they are recorded as a table; the shape of a bundle document is in ``operators.documents``.
ROLES = ("artifact", "log", "output", "plan", "state")


def bundle_faults(rows: DataFrame, bundle: str) -> DataFrame:
    """(bundle, path, rule) for the sealed rows of bundles (bundle, role, path, sha256, size); each has one plan and one state."""
    c = F.col
    own = {"role": ~c("role").isin(*ROLES), "path": ~P.portable(c("path")), "identity": ~I.valid_identity(c("sha256"), c("size"))}
    row = rows.select(bundle, "path", F.explode(_broken(own)).alias("rule"))
    twice = rows.groupBy(bundle, "path").count().filter("count > 1").select(bundle, "path", F.lit("sealed twice").alias("rule"))
    whole = rows.groupBy(bundle).agg(F.count_if(c("role") == "plan").alias("plan"), F.count_if(c("role") == "state").alias("state"))
    lone = [whole.filter(c(role) != 1).select(bundle, F.lit(None).cast("string").alias("path"), F.lit(f"not one {role}").alias("rule")) for role in ("plan", "state")]
    return row.unionByName(twice).unionByName(lone[0]).unionByName(lone[1])


def context_sha(*fields: str) -> Column:
    """The digest of a context: SHA-256 of the canonical JSON of its fields in name order, nulls kept, with a newline."""
    return F.sha2(F.concat(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), F.lit("\n")), 256)


def context_bindings(attempts: DataFrame, plans: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Attempts that name another context than the plan does for their task, or one of a task that no plan has."""
    planned = plans.select(*keys, F.col(digest).alias("_planned"))
    return attempts.join(planned, keys, "left").filter(~F.col(digest).eqNullSafe(F.col("_planned"))).drop("_planned")


def volatile_overlap(volatile: DataFrame, immutable: DataFrame, key: str = "path") -> DataFrame:
    """Volatile paths that are also declared immutable, or lie below one that is."""
    n_volatile, n_immutable = volatile.count(), immutable.count()
    up = volatile.select(F.col(key), F.explode(F.concat(F.array(F.col(key)), P.ancestors(F.col(key)))).alias("_up"))
    rows = 4 * max(n_volatile, n_immutable)
    found = by_keys(up, rows, "_up").join(by_keys(immutable.select(F.col(key).alias("_up")), rows, "_up"), "_up", "left_semi").select(key)
    return by_keys(found, n_volatile, key).distinct()


def summary_matches(summary: DataFrame, records: DataFrame, key: str, value: str) -> DataFrame:
    """Per name of a summary or of records: status missing, extra, drift or match."""
    a, b = summary.select(key, F.struct(value).alias("_a")), records.select(key, F.struct(value).alias("_b"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "match").otherwise("drift")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def avoided_work(restarted: DataFrame, resumed: DataFrame, key: str) -> DataFrame:
    """Per run the calls and repeated successes that resuming spared: differences of two tables of ``state.work``."""
    a = restarted.select(key, F.col("calls").alias("_calls"), F.col("duplicates").alias("_duplicates"))
    return resumed.join(a, key).select(key, (F.col("_calls") - F.col("calls")).alias("avoided_calls"), (F.col("_duplicates") - F.col("duplicates")).alias("avoided_duplicates"))


def unstable(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two observations of one thing that are in one only, or differ: the keys of what changed between them."""
    return first.exceptAll(second).select(*keys).unionByName(second.exceptAll(first).select(*keys)).distinct()
