"""Queries on logs as streams, whole-log digests, replayed states, ordered lines and trees of files, with DuckDB oracles that start from nothing at each row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from provena.functions import identity as I
from provena.operators import eventlog, replay
from provena.plans import tables as t
from provena.shared import folder, streamed, text_files
from provena.sources import lines, packages, trees
from provena.streaming import runs


def _numbered(rows, run: str, order: str):
    return rows.withColumn("number", F.row_number().over(Window.partitionBy(run).orderBy(order)).cast("long"))


def _again(rows):
    """Some records a second time, some without their number."""
    return rows.unionByName(rows.filter("seq % 50 = 0")).unionByName(rows.filter("seq % 97 = 0").withColumn("number", F.lit(None).cast("long")))


def stream_chain(spark, sf):
    log = _again(_numbered(t.event_log(runs.session(spark), sf), "run", "seq"))
    return streamed(log.select("run", "seq", "number", "line"), "seq", lambda rows: runs.chained(rows, "run", "number", "line"))


def stream_phases(spark, sf):
    e = t.read(runs.session(spark), sf, "events", "user_id", "event_id", "event_type").withColumnsRenamed({"user_id": "run", "event_id": "seq"})
    outcome = F.when(F.col("event_type") == "signup", "awaiting_approval").when(F.col("event_type").isin("view", "click"), "completed").when(F.col("event_type") == "purchase", "verified").otherwise("blocked")
    rows = _again(_numbered(e.withColumn("outcome", outcome), "run", "seq"))
    return streamed(rows.select("run", "seq", "number", "outcome"), "seq", lambda rows: runs.phases(rows, "run", "number", "outcome"))


def log_digests(spark, sf):
    return eventlog.whole(t.event_log(spark, sf), "run", "seq", "line")


def workspace_replay(spark, sf):
    """Turns of a conversation write outputs over documents; some write over the document of their number, or remove it."""
    turns = t.read(spark, sf, "conversations", "conv_id", "turn", "text").withColumn("text", F.coalesce("text", F.lit("")))
    baseline = t.document_manifest(spark, sf)
    made = turns.select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.concat(F.lit("out/"), F.col("turn") % 3).alias("path"), I.sha256(F.col("text")).alias("sha256"), I.size_of(F.col("text")).alias("size"))
    paths = t.read(spark, sf, "documents", "doc_id", "source").select(F.col("doc_id").alias("run"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    over = turns.filter("turn % 4 IN (1, 3)").select(F.col("conv_id").alias("run"), F.col("turn").alias("step"), F.when(F.col("turn") % 4 == 1, I.sha256(F.col("text"))).alias("sha256"), I.size_of(F.col("text")).alias("size")).join(paths, "run")
    return replay.replay(baseline, made.unionByName(over.select(*made.columns)))


#: Documents whose lines are in one file.
CHUNK = 5_000


def _listed(spark, sf):
    """Documents as lines of checksum lists, one for each source and range of ids, in order but for drawn flaws: source, chunk, doc_id, line."""
    d = t.read(spark, sf, "documents", "doc_id", "source", "text")
    drawn = lambda place: t._digit("doc_id", place)
    number = F.when(drawn(3) == 0, F.col("doc_id") - F.col("doc_id") % 2).otherwise(F.col("doc_id"))
    name = F.concat(F.when(drawn(2) == 0, "!").when(drawn(2) == 1, "a//").otherwise("f/"), F.lpad(number.cast("string"), 12, "0"), F.when(drawn(4) == 0, "\r").otherwise(""))
    digest = I.sha256(F.coalesce("text", F.lit("")))
    line = F.concat(F.when(drawn(1) == 0, F.upper(digest)).otherwise(digest), F.lit("  "), name)
    return d.select(F.coalesce("source", F.lit("none")).alias("source"), F.expr(f"doc_id div {CHUNK}").alias("chunk"), "doc_id", line.alias("line"))


def _part(path, key: str):
    return F.url_decode(F.regexp_extract(path, f"/{key}=([^/]*)", 1))


def checksum_order(spark, sf):
    rows = lines.checksum_rows(lines.numbered_lines(spark, text_files(_listed(spark, sf), ["source", "chunk"], "doc_id", "line")))
    return rows.select(_part("path", "source").alias("source"), _part("path", "chunk").cast("long").alias("chunk"), "number", "start", "file", "ended", F.array_join("faults", ",").alias("faults"))


def tree_entries(spark, sf):
    """The tree of those lists, scanned twice; what the writer leaves beside them (names with a dot or underscore first) is left out."""
    root = text_files(_listed(spark, sf), ["source", "chunk"], "doc_id", "line")
    found = trees.observed(spark, root).filter(~F.col("path").rlike(r"(^|/)[._][^/]*$"))
    return found.select(F.regexp_replace(F.url_decode("path"), r"/part-[^/]*\.txt$", "/part").alias("path"), "kind", "size", "sha256")


def package_files(spark, sf):
    """The identities of up to 1000 documents of a source as a file each, published as a package and read back."""
    d = t.read(spark, sf, "documents", "doc_id", "source", "text")
    line = F.concat_ws(" ", F.lpad(F.col("doc_id").cast("string"), 12, "0"), I.sha256(F.coalesce("text", F.lit(""))))
    files = d.groupBy(F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.expr("doc_id div 1000").cast("string")).alias("name")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("content"))
    root = f"{folder(spark)}"
    packages.publish(files, root)
    return packages.verified(spark, root)


QUERIES = {f.__name__: f for f in (stream_chain, stream_phases, log_digests, workspace_replay, checksum_order, tree_entries, package_files)}

_LOG = "log AS (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS number, event_type, event_id || '|' || epoch_us(ts) || '|' || event_type || '|' || props || chr(10) AS line FROM events)"
_BAD = "UNION ALL SELECT run, number, {0}, 'number again' FROM log WHERE seq % 50 = 0 UNION ALL SELECT run, NULL, {0}, 'no run or number' FROM log WHERE seq % 97 = 0"
#: Nodes of a level of the tree from the members below it, as members of the level above; the root, once made, stays.
_LEVEL = """{to} AS (SELECT run, step, left(o.node, len(o.node) - 1) AS node, right(o.node, 1) AS name, sum(o.n) AS n, sum(o.size) AS size, sha256(string_agg(o.name || chr(0) || o.sha || chr(0) || o.size, chr(10) ORDER BY o.name)) AS sha,
        o.node = '' AS done FROM {of} o WHERE NOT o.done GROUP BY run, step, o.node UNION ALL SELECT * FROM {of} WHERE done)"""
_LISTS = f"""k AS (SELECT doc_id, coalesce(source, 'none') AS source, doc_id // {CHUNK} AS chunk, sha256(coalesce(text, '')) AS h, md5(doc_id::VARCHAR) AS m FROM documents),
    n AS (SELECT *, CASE {t.digit_sql(2)} WHEN 0 THEN '!' WHEN 1 THEN 'a//' ELSE 'f/' END || lpad((CASE WHEN {t.digit_sql(3)} = 0 THEN doc_id - doc_id % 2 ELSE doc_id END)::VARCHAR, 12, '0') || CASE WHEN {t.digit_sql(4)} = 0 THEN chr(13) ELSE '' END AS name,
      {t.digit_sql(1)} = 0 AS bad FROM k), l AS (SELECT *, CASE WHEN bad THEN upper(h) ELSE h END || '  ' || name AS line FROM n)"""
ORACLES = {
    "package_files": """WITH f AS (SELECT coalesce(source, 'none') || '/' || doc_id // 1000 AS name, string_agg(lpad(doc_id::VARCHAR, 12, '0') || ' ' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id) AS c FROM documents GROUP BY 1)
        SELECT name, sha256(c) AS sha256, strlen(c)::BIGINT AS size, 'match' AS status FROM f""",
    "checksum_order": f"""WITH {_LISTS}, f AS (SELECT *, CASE WHEN NOT bad THEN name END AS file FROM l), o AS (SELECT *, row_number() OVER w AS number, lag(file) OVER w AS before FROM f WINDOW w AS (PARTITION BY source, chunk ORDER BY doc_id))
        SELECT source, chunk, number, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY source, chunk ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, file, true AS ended,
          array_to_string([x FOR x IN [CASE WHEN bad THEN 'form' END, CASE WHEN contains(line, chr(13)) THEN 'ending' END, CASE WHEN NOT bad AND contains(name, '//') THEN 'path' END, CASE WHEN file <= before THEN 'order' END] IF x IS NOT NULL], ',') AS faults FROM o""",
    "tree_entries": f"""WITH {_LISTS} SELECT DISTINCT 'source=' || source AS path, 'directory' AS kind, NULL::BIGINT AS size, NULL AS sha256 FROM l
        UNION ALL SELECT DISTINCT 'source=' || source || '/chunk=' || chunk, 'directory', NULL, NULL FROM l
        UNION ALL SELECT 'source=' || source || '/chunk=' || chunk || '/part', 'file', sum(strlen(line) + 1)::BIGINT, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) FROM l GROUP BY source, chunk""",
    "stream_chain": f"""WITH {_LOG}, whole AS (SELECT run, number, coalesce(string_agg(line, '') OVER (PARTITION BY run ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, line FROM log)
        SELECT run, number, sha256(b) AS previous_sha256, sha256(b || line) AS sha256, strlen(b || line)::BIGINT AS size, NULL AS fault FROM whole {_BAD.format("NULL, NULL, NULL")}""",
    "stream_phases": f"""WITH {_LOG}, e AS (SELECT *, max(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM log),
        b AS (SELECT *, max(CASE WHEN event_type = 'error' OR (event_type = 'purchase' AND coalesce(c, 0) = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY number ROWS UNBOUNDED PRECEDING) AS bad FROM e)
        SELECT run, number, CASE WHEN bad = 1 THEN 'Blocked' WHEN event_type = 'signup' THEN 'AwaitingApproval' WHEN event_type = 'purchase' THEN 'Succeeded' ELSE 'Verifying' END AS phase, NULL AS fault FROM b {_BAD.format("NULL")}""",
    "log_digests": f"""WITH {_LOG} SELECT run, count(*) AS n, sum(strlen(line))::BIGINT AS bytes, max(strlen(line))::BIGINT AS longest, sha256(string_agg(line, '' ORDER BY seq)) AS sha256,
        count(*) <= 100000 AND sum(strlen(line)) <= 67108864 AND max(strlen(line)) <= 262144 AS within_limits FROM log GROUP BY run""",
    "workspace_replay": f"""WITH base AS (SELECT doc_id AS id, source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS size FROM documents),
        c AS (SELECT conv_id AS run, turn AS step, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS size FROM conversations),
        ch AS (SELECT run, step, 'out/' || step % 3 AS path, sha, size FROM c UNION ALL SELECT run, step, path, CASE WHEN step % 4 = 1 THEN c.sha END, c.size FROM c JOIN base ON id = run WHERE step % 4 IN (1, 3)),
        runs AS (SELECT DISTINCT run FROM ch), st AS (SELECT DISTINCT run, step FROM ch UNION ALL SELECT run, -1 FROM runs),
        every AS (SELECT run, -1 AS since, path, sha, size FROM runs, base UNION ALL SELECT * FROM ch),
        held AS (SELECT st.run, st.step, path, arg_max({{'sha': sha, 'size': size}}, since) AS e FROM st JOIN every ON every.run = st.run AND since <= st.step GROUP BY 1, 2, 3),
        digits AS (SELECT min(d) AS d FROM range(1, 9) g(d) WHERE 16::DOUBLE ** d >= (SELECT count(*) FROM base)),
        leaf AS (SELECT run, step, sha256(path)[1:d] AS node, path AS name, 1 AS n, e.size AS size, e.sha AS sha, false AS done FROM held, digits WHERE e.sha IS NOT NULL),
        {", ".join(_LEVEL.format(to=f"l{i + 1}", of=f"l{i}" if i else "leaf") for i in range(9))}
        SELECT run, step::BIGINT AS step, n::BIGINT AS n_entries, size::BIGINT AS total_bytes, sha AS root_sha256 FROM l9""",
}
