"""Queries on identities, manifests, event logs, lineage and evidence sets over the given tables, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import canonical, paths
from provena.functions import identity as I
from provena.operators import eventlog, evidence, lineage, manifest
from provena.plans import tables as t


def identity_documents(spark, sf):
    d = t.read(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", I.sha256(F.coalesce("text", F.lit(""))).alias("sha256"), I.size_of(F.coalesce("text", F.lit(""))).alias("size"))


def manifest_diff(spark, sf):
    return manifest.diff(t.recorded_orders(spark, sf), t.derived_orders(spark, sf))


def tree_summary(spark, sf):
    entries = t.document_manifest(spark, sf).withColumn("source", F.split_part("path", F.lit("/"), F.lit(1)))
    return manifest.tree_summary(entries, "source")


def projected_state(spark, sf):
    return manifest.projected(t.recorded_orders(spark, sf), t.document_manifest(spark, sf))


def manifest_violations(spark, sf):
    return manifest.violations(t.flawed_manifest(spark, sf))


def workspace_history(spark, sf):
    sealed = t.read(spark, sf, "conversations", "conv_id", "turn", "text").select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), I.size_of(F.coalesce("text", F.lit(""))).alias("size"))
    return manifest.history(t.document_manifest(spark, sf), sealed)


def canonical_order(spark, sf):
    turns = t.read(spark, sf, "conversations", "conv_id", "turn", "text")
    return manifest.out_of_order(turns, "conv_id", "turn", "text").select("conv_id", "turn")


def event_chain(spark, sf):
    return eventlog.chain(t.event_log(spark, sf), "run", "seq", "line")


def event_chain_window(spark, sf):
    return eventlog.chain_by_window(t.event_log(spark, sf), "run", "seq", "line")


def event_contiguity(spark, sf):
    return eventlog.contiguity(t.event_log(spark, sf), "run", "seq", "micros")


def event_observation(spark, sf):
    return eventlog.observation(t.event_log(spark, sf), "run", F.col("line"))


def transition_status(spark, sf):
    acknowledged = F.max(F.col("number") - F.col("run") % 3).cast("long")
    log = t.attempts(spark, sf).groupBy("run").agg(F.count("*").alias("logged"), acknowledged.alias("acknowledged"), F.max("done").alias("some_done"), F.min("done").alias("all_done"), (F.min("task") % 5 != 0).alias("same_prefix"))
    status = eventlog.transition_status(F.col("acknowledged"), F.col("logged"), F.col("some_done") != F.col("all_done"), F.col("same_prefix"))
    return log.select("run", "logged", "acknowledged", status.alias("status"))


def lineage_seeds(spark, sf):
    return lineage.seeds(t.task_inputs(spark, sf), t.task_outputs(spark, sf))


def lineage_double_producers(spark, sf):
    return lineage.double_producers(t.task_outputs(spark, sf))


def lineage_overwritten_seeds(spark, sf):
    return lineage.overwritten_seeds(t.task_inputs(spark, sf), t.task_outputs(spark, sf))


def lineage_expected_inputs(spark, sf):
    ident = lambda c: [I.sha256(c).alias("sha256"), I.size_of(c).alias("size")]
    sup = t.read(spark, sf, "supplier", "s_suppkey", "s_name").select(F.concat(F.lit("n/"), F.col("s_suppkey").cast("string")).alias("path"), *ident(F.col("s_name")))
    done = t.read(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").filter("o_orderstatus = 'F'")
    sealed = done.select(F.col("o_orderkey").alias("task"), F.concat(F.lit("n/"), F.col("o_custkey").cast("string")).alias("path"), *ident(F.col("o_orderpriority")))
    return lineage.expected_inputs(t.task_inputs(spark, sf), t.task_outputs(spark, sf), sup, sealed)


def ancestor_conflicts(spark, sf):
    return lineage.ancestor_conflicts(t.url_paths(spark, sf))


def alias_collisions(spark, sf):
    words = t.read(spark, sf, "pages", "url").select(F.split_part(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit(1)).alias("path"))
    return lineage.alias_collisions(words.unionByName(words.select(F.upper("path").alias("path"))), paths.alias_key(F.col("path")))


def portable_paths(spark, sf):
    p = t.url_paths(spark, sf)
    return p.select("path", paths.portable(F.col("path")).alias("portable"), paths.depth(F.col("path")).cast("long").alias("depth"))


def canonical_json(spark, sf):
    e, text = t.json_texts(spark, sf), F.col("text")
    return e.select("event_id", canonical.canonical_json(text).alias("canonical"), canonical.native_is_canonical(text).alias("was_canonical"), canonical.json_fault(text).alias("fault"))


def derived_names(spark, sf):
    a = t.attempts(spark, sf).withColumn("number", F.col("number") * 2345)  # of four digits and of five
    task, path = F.col("task").cast("string"), F.concat(F.lit("w/"), F.col("worker").cast("string"))
    return a.select("run", "task", "number", I.quarantine_name(task, F.col("number"), path).alias("quarantine"), I.log_name(task, F.col("number"), "stdout").alias("log"), I.job_name(F.col("run").cast("string"), F.lit("start"), task).alias("job"))


def path_set_digests(spark, sf):
    return t.task_inputs(spark, sf).groupBy("task").agg(F.collect_set("path").alias("p")).select("task", I.path_set_digest(F.col("p")).alias("digest"))


def evidence_exactness(spark, sf):
    return evidence.exactness(t.read(spark, sf, "orders", "o_orderkey").select(F.col("o_orderkey").alias("k")), t.read(spark, sf, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("k")), "k")


def evidence_conflicts(spark, sf):
    done = t.task_outputs(spark, sf).select("path")
    return evidence.conflicts(done, t.task_inputs(spark, sf).select("path"))


def evidence_binding(spark, sf):
    k = lambda table, c: t.read(spark, sf, table, c).select(F.col(c).alias("run"))
    return evidence.binding(k("documents", "doc_id"), k("labels", "doc_id"), k("embeddings", "vec_id"), "run")


def bundle_verify(spark, sf):
    return evidence.verify(evidence.bundle(t.recorded_orders(spark, sf), t.document_manifest(spark, sf)), evidence.bundle(t.derived_orders(spark, sf), t.document_manifest(spark, sf)))


def owner_cardinality(spark, sf):
    return evidence.cardinality(t.read(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("k")), t.read(spark, sf, "orders", "o_custkey").select(F.col("o_custkey").alias("k")), "k")


QUERIES = {f.__name__: f for f in (
    identity_documents, manifest_diff, tree_summary, projected_state, manifest_violations, workspace_history, canonical_order, event_chain, event_chain_window, event_contiguity, event_observation, transition_status,
    lineage_seeds, lineage_double_producers, lineage_overwritten_seeds, lineage_expected_inputs, ancestor_conflicts, alias_collisions, portable_paths, canonical_json, derived_names, path_set_digests,
    evidence_exactness, evidence_conflicts, evidence_binding, bundle_verify, owner_cardinality,
)}

_RECORDED = "rec AS (SELECT 'orders/' || o_orderkey AS path, sha256(o_orderstatus) AS sha256, strlen(o_orderstatus)::BIGINT AS size FROM orders)"
_DERIVED = "der AS (SELECT 'orders/' || l_orderkey AS path, sha256(s) AS sha256, strlen(s)::BIGINT AS size FROM (SELECT l_orderkey, CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS s FROM lineitem GROUP BY 1))"
_DOCS = "doc AS (SELECT source || '/' || doc_id AS path, source, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents)"
_LOG = "log AS (SELECT user_id AS run, event_id AS seq, epoch_us(ts) AS micros, event_id || '|' || epoch_us(ts) || '|' || event_type || '|' || props || chr(10) AS line FROM events)"
_IN = "inp AS (SELECT DISTINCT l_orderkey AS task, 'n/' || l_partkey AS path FROM lineitem)"
_OUT = "outp AS (SELECT o_orderkey AS task, 'n/' || o_custkey AS path FROM orders)"
_SEEDS = "seeds AS (SELECT i.path, i.reader FROM (SELECT path, min(task) AS reader FROM inp GROUP BY 1) i LEFT JOIN (SELECT path, min(task) AS producer FROM outp GROUP BY 1) o USING (path) WHERE producer IS NULL OR producer >= reader)"
_URLS = "urls AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
_CHAIN = f"WITH {_LOG} SELECT run, seq, sha256(coalesce(string_agg(line, '') OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS previous_sha256 FROM log"

ORACLES = {
    "identity_documents": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, ''))::BIGINT AS size FROM documents",
    "manifest_diff": f"""WITH {_RECORDED}, {_DERIVED} SELECT coalesce(rec.path, der.path) AS path, CASE WHEN der.path IS NULL THEN 'missing' WHEN rec.path IS NULL THEN 'extra' WHEN rec.sha256 = der.sha256 AND rec.size = der.size THEN 'match' ELSE 'drift' END AS status
        FROM rec
        FULL JOIN der ON rec.path = der.path""",
    "tree_summary": f"""WITH {_DOCS} SELECT source, count(*) AS n_entries, 0::BIGINT AS n_directories, count(*) AS n_files, sum(size)::BIGINT AS total_bytes,
        sha256('{{"entries":[' || string_agg('{{"kind":"file","path":"' || path || '","sha256":"' || sha256 || '","size":' || size || '}}', ',' ORDER BY path) || '],"kind":"tree","schema_version":1}}' || chr(10)) AS tree_sha256 FROM doc GROUP BY source""",
    "projected_state": f"""WITH {_RECORDED}, {_DOCS} SELECT path, 'file' AS kind, min(sha256) AS sha256, min(size) AS size, count(*) > 1 AS collides
        FROM (SELECT path, sha256, size
        FROM rec
        UNION ALL SELECT path, sha256, size
        FROM doc)
        GROUP BY path""",
    "manifest_violations": f"""WITH k AS (SELECT *, md5(doc_id::VARCHAR) AS m, coalesce(text, '') AS t FROM documents), s AS (SELECT DISTINCT source, {t.digit_sql(1, "md5(source)")} < 4 AS is_file FROM documents WHERE source IS NOT NULL),
        e AS (SELECT CASE {t.digit_sql(1)} WHEN 0 THEN 'a//' || doc_id WHEN 1 THEN repeat('d/', 33) || doc_id WHEN 2 THEN source || '/same' ELSE source || '/' || doc_id END AS path, CASE WHEN {t.digit_sql(2)} = 0 THEN 'directory' ELSE 'file' END AS kind,
            {t.digit_sql(3)} = 0 AS odd_digest, CASE {t.digit_sql(4)} WHEN 0 THEN 1073741825 WHEN 1 THEN -1 ELSE strlen(t) END AS size FROM k
          UNION ALL SELECT source, CASE WHEN is_file THEN 'file' ELSE 'directory' END, false, CASE WHEN is_file THEN strlen(source) END FROM s),
        up AS (SELECT path, array_to_string(string_split(path, '/')[1:i], '/') AS up FROM (SELECT DISTINCT path, unnest(range(1, len(string_split(path, '/')))) AS i FROM e))
        SELECT path, 'path not portable' AS rule FROM e WHERE list_contains(string_split(path, '/'), '')
        UNION ALL SELECT path, 'too deep' FROM e WHERE len(string_split(path, '/')) > 32
        UNION ALL SELECT path, 'bad identity' FROM e WHERE kind = 'file' AND (odd_digest OR size < 0)
        UNION ALL SELECT path, 'directory with identity' FROM e WHERE kind = 'directory' AND size IS NOT NULL
        UNION ALL SELECT path, 'file too large' FROM e WHERE size > 1073741824
        UNION ALL SELECT path, 'listed twice' FROM e GROUP BY path HAVING count(*) > 1
        UNION ALL SELECT DISTINCT path, 'parent not listed' FROM up WHERE up NOT IN (SELECT path FROM e WHERE kind = 'directory')
        UNION ALL SELECT DISTINCT path, 'below a file' FROM up WHERE up IN (SELECT path FROM e WHERE kind = 'file')""",
    "workspace_history": f"""WITH {_DOCS}, b AS (SELECT count(*) AS n, sum(size) AS s
        FROM doc),
      p AS (SELECT conv_id AS run, turn AS step, count(*) AS n, sum(strlen(coalesce(text, ''))) AS s
        FROM conversations
        GROUP BY 1, 2) SELECT run, step, ((SELECT n
        FROM b) + sum(n) OVER w)::BIGINT AS n_after, ((SELECT s
        FROM b) + sum(s) OVER w)::BIGINT AS bytes_after
        FROM p WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""",
    "canonical_order": "SELECT conv_id, turn FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b >= text",
    "event_chain": _CHAIN,
    "event_chain_window": _CHAIN,
    "event_contiguity": f"""WITH {_LOG}, m AS (SELECT *, seq - lag(seq) OVER w AS gap, lag(micros) OVER w > micros AS back
        FROM log WINDOW w AS (PARTITION BY run ORDER BY seq)) SELECT run, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (gap <> 1) AS n_gaps, count(*) FILTER (back) AS n_backwards
        FROM m
        GROUP BY run""",
    "event_observation": f"""WITH {_LOG} SELECT run, count(*) AS n, sum(strlen(line))::BIGINT AS bytes, max(strlen(line))::BIGINT AS longest, count(*) <= 100000 AND sum(strlen(line)) <= 67108864 AND max(strlen(line)) <= 262144 AS within_limits
        FROM log
        GROUP BY run""",
    "transition_status": """WITH l AS (SELECT l_orderkey AS run, count(*) AS logged, max(l_linenumber - l_orderkey % 3)::BIGINT AS acknowledged, bool_or(l_linestatus = 'F') <> bool_and(l_linestatus = 'F') AS pending, min(l_partkey) % 5 = 0 AS other FROM lineitem GROUP BY 1)
        SELECT run, logged, acknowledged, CASE WHEN other THEN 'diverged' WHEN NOT pending AND logged = acknowledged THEN 'stable' WHEN pending AND logged = acknowledged THEN 'pending_before_log' WHEN pending AND logged = acknowledged + 1 THEN 'pending_after_log' ELSE 'diverged' END AS status FROM l""",
    "lineage_seeds": f"WITH {_IN}, {_OUT}, {_SEEDS} SELECT * FROM seeds",
    "lineage_double_producers": f"WITH {_OUT} SELECT path, count(DISTINCT task) AS n FROM outp GROUP BY 1 HAVING count(DISTINCT task) > 1",
    "lineage_overwritten_seeds": f"WITH {_IN}, {_OUT}, {_SEEDS} SELECT path, reader, min(task) AS producer FROM seeds JOIN outp USING (path) GROUP BY 1, 2",
    "lineage_expected_inputs": f"""WITH {_IN}, {_OUT}, s AS (SELECT 'n/' || s_suppkey AS path, sha256(s_name) AS h, strlen(s_name)::BIGINT AS z FROM supplier),
        p AS (SELECT path, min(task) AS producer FROM outp GROUP BY 1), m AS (SELECT o_orderkey AS producer, 'n/' || o_custkey AS path, sha256(o_orderpriority) AS h, strlen(o_orderpriority)::BIGINT AS z FROM orders WHERE o_orderstatus = 'F')
        SELECT task, inp.path, CASE WHEN s.h IS NOT NULL THEN 'seed' WHEN p.producer IS NULL THEN 'no producer' WHEN p.producer >= task THEN 'produced later' WHEN m.h IS NULL THEN 'producer not completed' ELSE 'output' END AS origin,
        coalesce(s.h, CASE WHEN p.producer < task THEN m.h END) AS sha256, coalesce(s.z, CASE WHEN p.producer < task THEN m.z END) AS size
        FROM inp LEFT JOIN s USING (path) LEFT JOIN p USING (path) LEFT JOIN m ON m.path = inp.path AND m.producer = p.producer""",
    "ancestor_conflicts": f"""WITH {_URLS}, u AS (SELECT DISTINCT path
        FROM urls) SELECT a.path, b.path AS ancestor
        FROM u a JOIN u b ON starts_with(a.path, b.path || '/')""",
    "alias_collisions": """WITH h AS (SELECT split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 1) AS path
        FROM pages),
      a AS (SELECT path
        FROM h UNION SELECT upper(path)
        FROM h) SELECT lower(path) AS alias, count(*) AS n_spellings, min(path) AS first_spelling
        FROM a
        GROUP BY 1
        HAVING count(*) > 1""",
    "portable_paths": f"""WITH {_URLS} SELECT path, strlen(path) BETWEEN 1 AND 1024 AND NOT regexp_matches(path, '[\\x00\\\\:]') AND NOT list_bool_or([x IN ('', '.', '..') FOR x IN string_split(path, '/')]) AS portable, len(string_split(path, '/'))::BIGINT AS depth
        FROM urls""",
    "canonical_json": """SELECT event_id, CASE WHEN event_id % 8 < 3 THEN replace(props, ' ', '') || chr(10) WHEN event_id % 8 = 6 THEN '{"a":2,"b":1}' || chr(10) END AS canonical, event_id % 8 = 2 AS was_canonical,
        ['not canonical', 'not canonical', NULL, 'duplicate key', 'NaN is not JSON', 'invalid', 'not canonical', 'too complex'][event_id % 8 + 1] AS fault FROM events""",
    "derived_names": """SELECT l_orderkey AS run, l_partkey AS task, n AS number,
        'a' || format('{:08d}', n) || '.' || sha256(l_partkey::VARCHAR || chr(0) || n::VARCHAR || chr(0) || 'w/' || l_suppkey::VARCHAR) || '.artifact' AS quarantine,
        'logs/' || l_partkey || '/attempt-' || format('{:04d}', n) || '.stdout.log' AS log, 'agentrun-start-' || substr(sha256(l_orderkey::VARCHAR || chr(0) || 'start' || chr(0) || l_partkey::VARCHAR), 1, 16) AS job
        FROM (SELECT *, l_linenumber * 2345 AS n FROM lineitem)""",
    "path_set_digests": f"""WITH {_IN} SELECT task, sha256('[' || string_agg('"' || path || '"', ',' ORDER BY path) || ']' || chr(10)) AS digest FROM inp GROUP BY task""",
    "evidence_exactness": """SELECT o_orderkey AS k, 'missing' AS fault
        FROM (SELECT o_orderkey
        FROM orders EXCEPT SELECT l_orderkey
        FROM lineitem)
        UNION ALL SELECT l_orderkey, 'unexpected'
        FROM (SELECT l_orderkey
        FROM lineitem EXCEPT SELECT o_orderkey
        FROM orders)""",
    "evidence_conflicts": f"WITH {_IN}, {_OUT} SELECT path FROM outp INTERSECT SELECT path FROM inp",
    "evidence_binding": """WITH a AS (SELECT doc_id AS run, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT doc_id AS run, count(*) AS n FROM labels GROUP BY 1), c AS (SELECT vec_id AS run, count(*) AS n FROM embeddings GROUP BY 1)
        SELECT run, coalesce(a.n, 0) AS n_plan, coalesce(b.n, 0) AS n_state, coalesce(c.n, 0) AS n_log, coalesce(a.n, 0) = 1 AND coalesce(b.n, 0) = 1 AND coalesce(c.n, 0) = 1 AS bound FROM a FULL JOIN b USING (run) FULL JOIN c USING (run)""",
    "bundle_verify": f"""WITH {_RECORDED}, {_DERIVED}, {_DOCS}, x AS (SELECT path, sha256, size FROM rec UNION ALL SELECT path, sha256, size FROM doc), y AS (SELECT path, sha256, size FROM der UNION ALL SELECT path, sha256, size FROM doc),
        d AS (SELECT CASE WHEN y.path IS NULL THEN 'missing' WHEN x.path IS NULL THEN 'extra' WHEN x.sha256 = y.sha256 THEN 'match' ELSE 'drift' END AS s FROM x FULL JOIN y ON x.path = y.path)
        SELECT count(*) FILTER (s = 'match') AS n_match, count(*) FILTER (s = 'drift') AS n_drift, count(*) FILTER (s = 'missing') AS n_missing, count(*) FILTER (s = 'extra') AS n_extra, count(*) FILTER (s <> 'match') = 0 AS verified FROM d""",
    "owner_cardinality": """SELECT c_custkey AS k, count(o_custkey) AS n_owned, count(o_custkey) = 1 AS exactly_one
        FROM customer
        LEFT JOIN orders ON o_custkey = c_custkey
        GROUP BY 1""",
}
