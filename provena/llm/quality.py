"""Quality rules by cross-document line frequency (native: DataFrame functions only).

Normalised lines are hashed, the documents (or distinct texts) with each are counted per host, lines above the host's
limit are boilerplate and are removed, and a document that keeps too little besides them is rejected as depleted. Before
that, base rules reject documents with few words or much repetition inside the text.

For the counts what crosses a shuffle is one (host, line hash) row per distinct line of a document, summed on the map
side first (where copies count once, before that the line hashes of each distinct text of a host, once a task). A host or a
line that holds a third of all rows only adds to counts. The table of boilerplate lines is bounded per host (each is in over
``share`` of its documents); it is broadcast after a check of its row count, and texts stay in their tasks. Beyond that the
texts meet their own boilerplate lines by a shuffle.

Edge cases: a null or empty text has no words and fails the base rules; a null host is a host of its own; documents
with equal id and text are counted one by one (unless copies count once) and get equal verdicts; a line at its host's limit, and a document with just
``least_left`` of its text left, stay; an empty table gives an empty result. Lines
of equal 64-bit hash are taken as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import WORD, kept_after, table, written

SYMBOLS = r"[#*$%&|<>]"


def _repeated(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words, the words that lie in a 3-word window found twice or more, from the array _words.

    The windows' hashes are sorted with their places, so equal ones are neighbours and no text costs the square of its
    length. Each array is a column of its own, as what a lambda encloses is computed anew for each element."""
    words = F.col("_words")
    out = docs.withColumn("_hashes", F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))))
    any_twice = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    out = out.withColumn("_placed", F.when(any_twice, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    placed = F.col("_placed")
    twice = F.transform("_placed", lambda e, k: F.when((F.get(placed, k - 1)["h"] == e["h"]) | (F.get(placed, k + 1)["h"] == e["h"]), e["i"]))
    out = out.withColumn("_twice", F.sort_array(F.filter(twice, lambda p: p.isNotNull())))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + (p + 3) - F.greatest(p, acc["end"])).alias("n"))
    n = F.coalesce(F.aggregate("_twice", start, step, lambda acc: acc["n"]), F.lit(0))
    return out.withColumn("n_repeat_words", n.cast("long")).drop("_hashes", "_placed", "_twice")


def base_rules(docs: DataFrame, text: str = "text", least_words: int = 50, most_repeat: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    base_failed: under ``least_words`` words, or more than ``most_repeat`` percent of them repeated."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = _repeated(out).withColumn("_lines", lines)
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines")


def normal_line(line: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def boilerplate(docs: DataFrame, text: str = "text", host: str = "source", least_docs: int = 20, share: float = 0.1, copies: bool = True) -> DataFrame:
    """The lines above their host's limit: (_bhost, _bh), a host and the hash of a normalised line, written.

    A line is boilerplate in a host when over max(least_docs, share * documents of the host) of its documents have
    it. Without ``copies``, lines and documents are counted once per distinct text of a host, so a group of copies
    cannot make its own lines boilerplate, however large it is; with it, each row counts, as in the SQL of op10."""
    body = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(F.filter(F.transform(F.split(body, "\n"), normal_line), lambda line: line != ""), lambda x: F.xxhash64(x))
    texts = docs.select(F.col(host).alias("_host"), F.xxhash64(body).alias("_text"), F.array_distinct(hashes).alias("_hs"))
    texts = texts if copies else texts.dropDuplicates(["_host", "_text"])
    per_host = docs.select(F.col(host).alias("_host"), F.xxhash64(body).alias("_text"))
    per_host = (per_host if copies else per_host.distinct()).groupBy("_host").agg(F.count("*").alias("_docs"))
    counted = texts.select("_host", F.explode("_hs").alias("_h")).groupBy("_host", "_h").agg(F.count("*").alias("_n"))
    limits = per_host.select(F.col("_host").alias("_host2"), F.greatest(F.lit(float(least_docs)), share * F.col("_docs")).alias("_limit")).filter(F.col("_limit").isNotNull())
    above = counted.filter(F.col("_n") > least_docs).join(limits, F.col("_host").eqNullSafe(F.col("_host2"))).filter(F.col("_n") > F.col("_limit"))
    return written(above.select(F.col("_host").alias("_bhost"), F.col("_h").alias("_bh")))


def stripped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", broadcast_rows: int = 200_000, **limits) -> DataFrame:
    """``docs`` with _stripped, the text without its boilerplate lines, and _left, the share of its normalised characters that remains.

    The other lines stay as they are, blank ones included. A text without boilerplate lines, null too, is unchanged
    and has all of it left. Few boilerplate lines are broadcast as one array a host, so texts stay where they are;
    many are joined with line hashes, and what meets the text by id, hash and host is the array of its own."""
    above = boilerplate(docs, text, host, **limits)
    body = F.coalesce(F.col(text), F.lit(""))
    if above.limit(broadcast_rows + 1).count() <= broadcast_rows:
        hot = above.groupBy("_bhost").agg(F.collect_list("_bh").alias("_bhs"))
        out = docs.join(F.broadcast(hot), F.col(host).eqNullSafe(F.col("_bhost")), "left").drop("_bhost")
    else:
        each = docs.select(F.col(id_col).alias("_bid"), F.xxhash64(body).alias("_btext"), F.col(host).alias("_bhost2"), F.explode(F.array_distinct(F.transform(F.split(body, "\n"), lambda line: F.xxhash64(normal_line(line))))).alias("_h"))
        hit = each.join(above, (F.col("_h") == F.col("_bh")) & F.col("_bhost2").eqNullSafe(F.col("_bhost")), "left_semi")
        hit = hit.groupBy("_bid", "_btext", "_bhost2").agg(F.collect_set("_h").alias("_bhs"))
        same = F.col(id_col).eqNullSafe(F.col("_bid")) & (F.xxhash64(body) == F.col("_btext")) & F.col(host).eqNullSafe(F.col("_bhost2"))
        out = docs.join(hit, same, "left").drop("_bid", "_btext", "_bhost2")
    # hashes and widths first, then the verdict of each line: what a lambda encloses is computed anew for each element
    normal = F.when(F.col("_bhs").isNotNull(), F.transform(F.split(body, "\n"), lambda line: F.struct(line.alias("l"), normal_line(line).alias("n"))))
    out = out.withColumn("_normal", normal)
    out = out.withColumn("_lines", F.transform("_normal", lambda x: F.struct(x["l"].alias("l"), F.char_length(x["n"]).cast("long").alias("w"), ((x["n"] != "") & F.array_contains("_bhs", F.xxhash64(x["n"]))).alias("hot"))))
    total = F.aggregate("_lines", F.lit(0).cast("long"), lambda acc, x: acc + x["w"])
    gone = F.aggregate("_lines", F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["hot"], x["w"]).otherwise(0))
    out = out.withColumns({"_total": total, "_gone": gone})
    rest = F.array_join(F.transform(F.filter("_lines", lambda x: ~x["hot"]), lambda x: x["l"]), "\n")
    out = out.withColumns({"_stripped": F.when(F.col("_gone") > 0, rest).otherwise(F.col(text)), "_left": F.when(F.col("_gone") > 0, 1 - F.col("_gone") / F.col("_total")).otherwise(1.0)})
    return out.drop("_bhs", "_normal", "_lines", "_total", "_gone")


def quality(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", least_left: float = 0.3, **limits) -> DataFrame:
    """``docs`` with the text without its boilerplate lines (n_chars, where there is one, follows it), the base figures and
    base_failed of the text as it came, depleted (less than ``least_left`` of the text is left) and kept (neither).

    All columns of ``docs`` stay."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_provena_row"), F.col(text).alias("text"))
    out = stripped(base_rules(whole), f"_provena_row.`{id_col}`", "text", f"_provena_row.`{host}`", **limits)
    out = out.withColumn("depleted", F.col("_left") < least_left).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    figures = [c for c in out.columns if c not in ("_provena_row", "text", "_stripped", "_left")]
    return out.select(*_with_text(docs, text), *figures)


def _with_text(docs: DataFrame, text: str = "text") -> list[Column]:
    """The columns of ``docs`` from _provena_row, the text and its n_chars from _stripped where lines are gone."""
    new = {text: F.col("_stripped"), "n_chars": F.when(F.col("_left") < 1, F.char_length("_stripped")).otherwise(F.col("_provena_row.n_chars")) if "n_chars" in docs.columns else None}
    return [(new[f.name].cast(f.dataType) if f.name in new else F.col(f"_provena_row.`{f.name}`")).alias(f.name) for f in docs.schema]


def cleaned(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", least_left: float = 0.3, **limits) -> DataFrame:
    """The documents that base rules and boilerplate leave, without their boilerplate lines; the columns of ``docs``."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_provena_row"), F.col(text).alias("text"))
    base = base_rules(whole).withColumn("_provena_failed", F.col("base_failed"))
    base = base.select("_provena_row", "text", "_provena_failed")
    out = stripped(base, f"_provena_row.`{id_col}`", "text", f"_provena_row.`{host}`", **limits)
    return kept_after(out, ~F.col("_provena_failed") & (F.col("_left") >= least_left)).select(*_with_text(docs, text))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the base figures, base_failed and the verdict by what is left of the text without its boilerplate lines."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    out = stripped(base_rules(docs))
    kept = ~F.col("base_failed") & (F.col("_left") >= 0.3)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
gg AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS s FROM g),
tw AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM gg) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM tw, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
raw AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM raw WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
nl AS (SELECT r, trim(regexp_replace(lower(l), '[^\p{L}\p{N}]+', ' ', 'g')) AS l FROM raw),
ll AS (SELECT nl.r, d.source, l, length(l) AS c FROM nl JOIN d USING (r) WHERE l <> ''),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT source, l, count(DISTINCT r) AS n FROM ll GROUP BY source, l),
hot AS (SELECT f.source, l FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > greatest(20.0, 0.1::DOUBLE * h.n)),
lft AS (SELECT ll.r, 1 - sum(CASE WHEN hot.l IS NOT NULL THEN c ELSE 0 END)::DOUBLE / sum(c)::DOUBLE AS s
        FROM ll LEFT JOIN hot ON hot.l = ll.l AND hot.source IS NOT DISTINCT FROM ll.source GROUP BY ll.r),
b AS (SELECT d.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lft.s, 1) AS s
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN lft USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND s >= 0.3::DOUBLE AS kept
FROM b
"""
