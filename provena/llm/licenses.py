"""License scans by diagonal voting.

Every run of k words of a text is hashed and joined with the runs of the templates. A run at word p that a template has at word t
votes for the diagonal p - t, an alignment of the whole template with the text. Words changed in place keep the
diagonal, words put in or left out move to a neighbouring one; diagonals with enough votes that lie within a quarter of the
template of each other are merged to a span. A span is verified: each vote has compared the words themselves (not only hashes), and
the share of the template's words that the votes cover must reach the template's own limit, as must, halved, the share of
the span's words. A phrase is a template of limit 1 that merges nothing: all its words, in a row.

The templates are a parameter and number some hundreds of runs; they are broadcast after a count, and beyond it the join
shuffles. Texts stay in their tasks: what crosses a shuffle is a row per text, template and diagonal, with the set of
template words that voted. Frequent runs only add votes on the map side, and rows are linear in the words of a text.

Edge cases: null and wordless texts have no words and no labels; rows of equal id and text get equal results, each its own row; a
null id is an id; nested and overlapping places all count; of templates with equal label the better share counts; an empty table gives no
rows; a table of templates without a run of k words is refused. Columns named as those of the result are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import small, table, written
from provena.llm.decontaminate import words_of

GRAM = 3
#: Runs of templates, and found documents, that are broadcast at most.
MOST_RUNS, MOST_FOUND = 100_000, 200_000


@dataclass(frozen=True)
class Template:
    """A label, a text, the least share of its words that a span must have, and whether it is a phrase of the base rules."""

    label: str
    text: str
    least: float = 1.0
    base: bool = False


#: The phrases of the contract and their labels.
PHRASES = (Template("mit", "under the mit license", base=True), Template("apache-2", "apache license version 2", base=True), Template("cc-by-nc", "cc by nc", base=True))
#: Short notices, of which every word counts, and the public standard wording of common licenses, most of whose words must be there.
NOTICES = (
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "mozilla public license v 2"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-nc", "creative commons attribution non commercial"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc0", "creative commons zero"),
    Template("proprietary", "all rights reserved no part of this publication may be reproduced"),
)
BODIES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""", 0.6),
    Template("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License.""", 0.6),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
        met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions
        in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""", 0.6),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details.""", 0.6),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies.""", 0.7),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/.""", 0.7),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", 0.7),
)
TEMPLATES = PHRASES + NOTICES + BODIES


def _runs(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    """Per run of k words of a template: its hash and words, the place in the template, and the template's figures."""
    rows = [(i, x.label, x.text, x.least, x.base) for i, x in enumerate(templates)]
    words = spark.createDataFrame(rows, "template int, label string, body string, least double, base boolean").withColumn("ws", words_of(F.col("body"))).withColumn("n", F.size("ws"))
    short = [r["label"] for r in words.filter(F.col("n") < k).collect()]
    if short or not rows:
        raise ValueError(f"templates of under {k} words: {short}")
    each = words.withColumn("hs", _hashes("ws", k)).select("template", "label", "least", "base", "n", "ws", F.posexplode("hs").alias("t", "rh"))
    return each.select("rh", F.array_join(F.slice("ws", F.col("t") + 1, F.lit(k)), " ").alias("run"), "t", "template", "label", "least", "base", "n")


def _hashes(words: str, k: int) -> Column:
    col = F.col(words)
    heads = F.slice(col, F.lit(1), F.greatest(F.size(col) - (k - 1), F.lit(0)))
    return F.transform(heads, lambda x, i: F.xxhash64(x, *[F.get(col, i + j) for j in range(1, k)]))


def spans(docs: DataFrame, keys: list[str], text: str = "text", templates: tuple[Template, ...] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """Per verified span: the keys, label, base, first and last (places of its first and last covered word) and share of the template's words.

    ``keys`` tell documents apart; rows of equal keys must have equal texts."""
    runs = _runs(docs.sparkSession, templates, k)
    fits = runs.limit(MOST_RUNS + 1).count() <= MOST_RUNS
    spread = docs.select(*keys, words_of(F.col(f"`{text}`")).alias("_ws")).withColumn("_hs", _hashes("_ws", k))
    # an outer explode adds no filter, which would compute the words a second time
    spread = spread.select(*keys, "_ws", F.posexplode_outer("_hs").alias("_p", "_h"))
    if fits:
        votes = spread.join(F.broadcast(runs), (F.col("_h") == F.col("rh")) & (F.array_join(F.slice("_ws", F.col("_p") + 1, F.lit(k)), " ") == F.col("run")))
    else:
        spread = spread.select(*keys, "_p", "_h", F.array_join(F.slice("_ws", F.col("_p") + 1, F.lit(k)), " ").alias("_run"))
        votes = spread.join(runs, (F.col("_h") == F.col("rh")) & (F.col("_run") == F.col("run")))
    # a set, not a count: rows that are there twice vote once
    alike = votes.groupBy(*keys, "template", "label", "base", "least", "n", (F.col("_p") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("ts"))
    whole = F.col("least") >= 1
    enough = F.when(whole, F.size("ts") == F.col("n") - (k - 1)).otherwise(F.size("ts") >= F.greatest(F.lit(2), F.ceil((F.col("n") - (k - 1)) / 10)))
    alike = alike.filter(enough)
    in_order = Window.partitionBy(*keys, "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(in_order) > F.when(whole, 0).otherwise(F.floor(F.col("n") / 4))
    merged = alike.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("span", F.sum("apart").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    covered = lambda shift: F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t + shift, t + shift + (k - 1)))))
    merged = merged.withColumns({"of_template": covered(F.lit(0)), "of_text": covered(F.col("diagonal"))})
    merged = merged.groupBy(*keys, "template", "label", "base", "least", "n", "span").agg(F.array_distinct(F.flatten(F.collect_list("of_template"))).alias("of_template"), F.array_distinct(F.flatten(F.collect_list("of_text"))).alias("of_text"))
    merged = merged.withColumns({"first": F.array_min("of_text").cast("long"), "last": F.array_max("of_text").cast("long"), "share": F.size("of_template") / F.col("n")})
    dense = F.size("of_text") >= F.col("least") / 2 * (F.col("last") - F.col("first") + 1)
    return merged.filter((F.col("share") >= F.col("least")) & dense).select(*keys, "label", "base", "first", "last", "share")


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word (of phrases), base_labels, labels (comma-joined) and score, the best share."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(body).alias("_text"), body.alias("_body"))
    found, base = spans(whole.select("_id", "_text", "_body"), ["_id", "_text"], "_body", **options), F.col("base")
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    found = found.groupBy(F.col("_id").alias("_fid"), F.col("_text").alias("_ftext")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("share").alias("score"),
    )
    # few documents have any license: they are broadcast after a count, and beyond it numbers shuffle, not texts
    out = whole.select("_row", "_id", "_text", F.size(words_of(F.col("_body"))).cast("long").alias("n_words")).join(small(written(found), MOST_FOUND), F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ftext")), "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *[(F.coalesce(F.col(c), none[c]) if c in none else F.col(c)).alias(c) for c in added])


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def oracle(templates: tuple[Template, ...] = TEMPLATES, k: int = GRAM) -> str:
    """The same rules in SQL over the same templates: phrases by text search at each word, spans from equal runs of words."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ",\n".join(f"({i}, {text(x.label)}, {text(' '.join(x.text.split()))}, {x.least}::DOUBLE, {str(x.base).lower()})" for i, x in enumerate(templates))
    words = lambda column: f"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH tm(i, label, body, least, base) AS (VALUES {rows}),
tw AS (SELECT i, label, least, base, {words("body")} AS ws FROM tm),
tr AS (SELECT i, label, least, base, len(ws) AS n, t, array_to_string(ws[t + 1:t + {k}], ' ') AS run FROM (SELECT *, unnest(range(len(ws) - {k - 1})) AS t FROM tw)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words("text")} AS ws FROM documents),
dr AS (SELECT r, p, array_to_string(ws[p + 1:p + {k}], ' ') AS run FROM (SELECT r, ws, unnest(range(len(ws) - {k - 1})) AS p FROM d WHERE len(ws) >= {k})),
v AS (SELECT r, i, label, least, base, n, t, p, p - t AS diagonal FROM dr JOIN tr USING (run)),
-- a phrase stands where all its words do
ph AS (SELECT r, label, least, base, p AS first, 1.0::DOUBLE AS share FROM d, tw, unnest(range(len(d.ws) - len(tw.ws) + 1)) g(p)
       WHERE least >= 1 AND len(d.ws) >= len(tw.ws) AND d.ws[p + 1] = tw.ws[1] AND d.ws[p + 1:p + len(tw.ws)] = tw.ws),
dg AS (SELECT r, i, diagonal, count(DISTINCT t) AS c, any_value(n) AS n FROM v WHERE least < 1 GROUP BY r, i, diagonal HAVING count(DISTINCT t) >= greatest(2, ceil((any_value(n) - {k - 1}) / 10.0))),
lg AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, i ORDER BY diagonal) <= n // 4 THEN 0 ELSE 1 END AS apart FROM dg),
sp AS (SELECT r, i, diagonal, sum(apart) OVER (PARTITION BY r, i ORDER BY diagonal) AS span FROM lg),
cv AS (SELECT v.r, v.i, span, any_value(label) AS label, any_value(least) AS least, any_value(base) AS base, any_value(n) AS n, count(DISTINCT v.t + o) AS ct, count(DISTINCT v.p + o) AS cp, min(v.p) AS first, max(v.p) + {k - 1} AS last
       FROM v JOIN sp USING (r, i, diagonal), unnest(range({k})) g(o) GROUP BY v.r, v.i, span),
f AS (SELECT r, label, base, first, share FROM ph UNION ALL
      SELECT r, label, base, first, ct::DOUBLE / n FROM cv WHERE ct::DOUBLE / n >= least AND cp >= least / 2 * (last - first + 1)),
a AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN a USING (r)
"""


ORACLE = oracle()
