"""Queries on shapes and bindings of recorded documents: plans, bundles and locks made of orders, with flaws drawn from the MD5 of a key."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from provena.operators import documents as D
from provena.plans import tables as t


def _orders(spark, sf):
    o = t.dealt(t.read(spark, sf, "orders", "o_orderkey"))
    return o.select(F.col("o_orderkey").alias("run"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("h"), *[t._digit("o_orderkey", i).alias(f"d{i}") for i in range(1, 7)])


def _filled(form: str, **values):
    """A text with the columns in the places of their names, which stand between angle brackets."""
    parts = re.split(f"<({'|'.join(values)})>", form)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


DESCRIPTOR = '{"digest":"sha256:<h>","media_type":"m","path":"c.json","size":3}'
BODY = f'"descriptor":{DESCRIPTOR},"environment":{{"inherit_parent":false,"runner_variables":["A"],"static_variables":{{}}}},"executable":{{"basename":"p","path_sha256":"<h>","path_utf8_size":4,"sha256":"<h>","size":8}},"process_scope":{{"cooperative":true,"mode":"m"}}}}'
PLAN = '{"execution_context":<context>,"kind":"plan","run_id":"<id>","schema_version":2,"seed_inputs":{"in":{"sha256":"<h>","size":5}},"suite":{"tasks":[{"id":"t1","outputs":["out"]}]},"suite_file":{"path":"suite.toml","sha256":"<h>","size":9}}'
OUTPUT = '{"task_id":"t1","path":"<path>","sha256":"<h>","size":1}'
BUNDLE = '{"run_id":"<id>","schema_version":<version>,<created>"kind":"bundle","seed_inputs":{"in":{"size":5,"sha256":"<h>"}<seed>},"suite_file":{"path":"<suite>","sha256":"<h>","size":<size>},"verified_outputs":[<outputs>],"run_artifacts":[],"execution_context":<context><more>}'


def _documents(spark, sf):
    """Per order the texts of a plan, canonical, and of a bundle in another spelling; some bundles have no plan."""
    h, one = F.col("h"), lambda place, value, bad, good: F.when(F.col(f"d{place}") == value, F.lit(bad)).otherwise(F.lit(good))
    _inner, inner = F.sha2(F.concat(_filled("{" + BODY, h=h), F.lit("\n")), 256), F.col("_inner")
    task = lambda seal: F.concat(F.lit('{"context_sha256":"'), seal, F.lit('",'), _filled(BODY, h=h))
    tasks = lambda seal: F.concat(_filled(f'"descriptor":{DESCRIPTOR},"tasks":{{"t1":', h=h), task(seal), F.lit("}}"))
    _outer, outer = F.sha2(F.concat(F.lit("{"), tasks(inner), F.lit("\n")), 256), F.col("_outer")
    context = lambda seal: F.concat(F.lit('{"context_sha256":"'), outer, F.lit('",'), tasks(seal))
    plan = _filled(PLAN, context=context(inner), id=F.substring(h, 1, 32), h=h)
    spelled = F.replace(context(F.when(F.col("d4") == 0, F.repeat(F.lit("0"), 64)).otherwise(inner)), F.lit('":'), F.lit('" : '))
    output = _filled(OUTPUT, path=one(5, 0, "other", "out"), h=h)
    bundle = _filled(
        BUNDLE, id=F.when(F.col("d2") == 1, "x").otherwise(F.substring(h, 1, 32)), version=one(2, 0, '"2"', "2"), created=one(1, 1, "", '"created_at":"t",'), seed=F.when(F.col("d4") == 1, _filled(',"b":{"sha256":"<h>","size":-1}', h=h)).otherwise(""),
        suite=one(3, 1, "../s", "suite.toml"), size=one(3, 0, "10", "9"), outputs=F.when(F.col("d5") == 1, F.concat(output, F.lit(", "), output)).otherwise(output), context=spelled,
        more=F.concat(one(1, 0, ',"more":1', ""), one(6, 0, ',"kind":"again"', "")), h=h,
    )
    rows = _orders(spark, sf).withColumn("_inner", _inner).withColumn("_outer", _outer)
    return rows.select("run", F.when(F.col("d6") != 1, plan).alias("plan"), bundle.alias("bundle"))


def bundle_documents(spark, sf):
    return D.bundle_faults(_documents(spark, sf), "run", "bundle", "plan", D.BUNDLES[2])


def lock_documents(spark, sf):
    d = lambda place, *values: t._one_of(F.col(f"d{place}"), *values)
    text = F.concat(
        F.lit('{"kind":"lock","lock_nonce":"'), F.when(F.col("d1") == 0, F.upper(F.substring("h", 1, 32))).otherwise(F.substring("h", 1, 32)), F.lit('","owner_pid":'), d(2, "0", "-1", "1.0", "true", "7", "7", "7", "7"),
        F.lit(',"owner_process_start_token":'), F.when(F.col("d3") == 0, F.concat(F.lit('"'), F.repeat(F.lit("t"), 513), F.lit('"'))).otherwise(d(3, '"a b"', "null", '""', "5", '"linux:1"')), F.lit(',"run_directory":"/r","schema_version":1'),
        d(4, ',"host":"h"', "", "", ""), F.lit("}"),
    )
    return D.shape_faults(D.flat(_orders(spark, sf).select("run", text.alias("text")), "run", "text"), "run", D.LOCK)


QUERIES = {f.__name__: f for f in (bundle_documents, lock_documents)}

_K = f"k AS (SELECT o_orderkey AS run, {', '.join(f'{t.digit_sql(i, "md5(o_orderkey::VARCHAR)")} AS d{i}' for i in range(1, 7))} FROM orders)"
ORACLES = {
    "bundle_documents": f"""WITH {_K}, s AS (SELECT * FROM k WHERE d6 <> 0), two AS (SELECT *, unnest(CASE WHEN d5 = 1 THEN [0, 1] ELSE [0] END) AS i FROM s)
        SELECT run, NULL AS pointer, 'json' AS rule FROM k WHERE d6 = 0
        UNION ALL SELECT run, '/more', 'unexpected' FROM s WHERE d1 = 0 UNION ALL SELECT run, '/created_at', 'missing' FROM s WHERE d1 = 1
        UNION ALL SELECT run, '/schema_version', 'kind' FROM s WHERE d2 = 0 UNION ALL SELECT run, '/run_id', 'value' FROM s WHERE d2 = 1
        UNION ALL SELECT run, '/suite_file/path', 'value' FROM s WHERE d3 = 1 UNION ALL SELECT run, '/seed_inputs/b/size', 'value' FROM s WHERE d4 = 1
        UNION ALL SELECT run, unnest(['/execution_context', '/execution_context/tasks/t1']), 'digest' FROM s WHERE d4 = 0
        UNION ALL SELECT run, '/schema_version', 'schema_version' FROM s WHERE d6 <> 1 AND d2 = 0 UNION ALL SELECT run, '/run_id', 'run_id' FROM s WHERE d6 <> 1 AND d2 = 1
        UNION ALL SELECT run, '/suite_file', 'suite_file' FROM s WHERE d6 <> 1 AND d3 < 2 UNION ALL SELECT run, '/execution_context', 'execution_context' FROM s WHERE d6 <> 1 AND d4 = 0
        UNION ALL SELECT run, '/seed_inputs', 'seed_inputs' FROM s WHERE d6 <> 1 AND d4 = 1 UNION ALL SELECT run, '', 'unbound' FROM s WHERE d6 = 1
        UNION ALL SELECT run, '/verified_outputs/' || i, 'undeclared' FROM two WHERE d6 = 1 OR d5 = 0 UNION ALL SELECT run, '/verified_outputs/' || i, 'sealed twice' FROM two WHERE d5 = 1""",
    "lock_documents": f"""WITH {_K} SELECT run, '/lock_nonce' AS pointer, 'value' AS rule FROM k JOIN orders ON o_orderkey = run WHERE d1 = 0 AND regexp_matches(sha256(run::VARCHAR)[1:32], '[a-f]')
        UNION ALL SELECT run, '/owner_pid', CASE WHEN d2 % 8 < 2 THEN 'value' ELSE 'kind' END FROM k WHERE d2 % 8 < 4
        UNION ALL SELECT run, '/owner_process_start_token', CASE WHEN d3 > 0 AND d3 % 5 = 3 THEN 'kind' ELSE 'value' END FROM k WHERE d3 = 0 OR d3 % 5 IN (2, 3)
        UNION ALL SELECT run, '/host', 'unexpected' FROM k WHERE d4 % 4 = 0""",
}
