"""Benchmark decontamination by winnowing (native: DataFrame functions only).

Words of a text are hashed as k-grams; in each sliding window of w k-grams the least hash is kept, with its place.
With k + w - 1 = t, two texts that share t words in a row keep the same k-gram of that span, so a join of the
fingerprints finds every shared span of t words. t is the least length of a benchmark window: 13 words, or fewer if a
benchmark item is shorter, so one pass guarantees all of them.

Each distinct benchmark window has one fingerprint (the least k-gram of its first w) with its place in the window. A
document's fingerprint that equals it is extended: the whole window is laid over the document at that place and
compared word by word. Only fingerprints go through the join; the document's words are referenced, not copied, while
the windows fit a broadcast whose size is checked. Beyond that the fingerprints carry the words around them and the
join shuffles. A passage in a third of all documents makes rows in proportion to its own words, per document.

Edge cases: null and empty texts have no words, no hits and aren't contaminated; null or wordless items have no window;
equal benchmark items each count as an item, and one without an id hits words but is not counted; repeated documents each get a
row; of equal least grams the left one is kept, on both sides; an empty benchmark leaves all clean, and an empty table gives no rows. Columns
of documents that are named as those of the result (n_words, n_hit, items, n_items, contaminated) are replaced in ``judged``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import ascii_lower, table, written

WINDOW = 13
#: Characters of words, after A-Z is lower case: ASCII digits and letters, and all beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a packed fingerprint hold its place, the others the hash; a text has fewer than 2^30 words.
PLACE = 30
LONGEST_GRAM = 5


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def _packed(words: str, k: int) -> Column:
    """For each k-gram: hash in the high bits, place in the low ones."""
    col = F.col(words)
    grams = F.slice(col, F.lit(1), F.greatest(F.size(col) - (k - 1), F.lit(0)))
    mask = (1 << PLACE) - 1
    return F.transform(grams, lambda x, i: F.xxhash64(x, *[F.get(col, i + j) for j in range(1, k)]).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))


def _winnowed(packed: str, w: int) -> Column:
    """The least of each w neighbours, each once; the place breaks ties to the left."""
    col = F.col(packed)
    heads = F.slice(col, F.lit(1), F.greatest(F.size(col) - (w - 1), F.lit(0)))
    least = F.transform(heads, lambda x, i: F.least(x, *[F.get(col, i + j) for j in range(1, w)])) if w > 1 else heads
    return F.array_distinct(least)


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct window: its text, its number of words and the items that have it."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text)).alias("ws")).filter(F.size("ws") > 0)
    n = F.least(F.size("ws"), F.lit(window))
    each = words.select("item", "ws", n.alias("n"), F.explode(F.sequence(F.lit(1), F.size("ws") - n + 1)).alias("at"))
    return each.select("item", "n", F.array_join(F.slice("ws", F.col("at"), F.col("n")), " ").alias("window")).distinct()


def hits(docs: DataFrame, items: DataFrame, keys: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int = 300_000) -> DataFrame:
    """Per key of documents with hits: n_hit, and items, the sorted array of item ids with occurring windows.

    ``keys`` tell documents apart; rows of equal keys must have equal texts."""
    each = written(benchmark_windows(items, item_id, item_text, window))
    shortest = each.agg(F.min("n").alias("n")).first()["n"] or window
    k = min(LONGEST_GRAM, shortest)
    w = shortest - k + 1
    one = each.select("window", "n").distinct().withColumn("ws", F.split("window", " "))
    one = one.withColumn("v", _packed("ws", k)).withColumn("v", F.array_min(F.slice("v", 1, w)))
    one = one.select("window", "n", F.shiftright("v", PLACE).alias("bh"), F.col("v").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("off"))
    fits = each.limit(broadcast_rows + 1).count() <= broadcast_rows
    spread = docs.select(*keys, words_of(F.col(text)).alias("ws")).withColumn("v", _packed("ws", k)).withColumn("v", _winnowed("v", w))
    at = F.col("f").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
    # explode() would add a filter on the array, pushed below the steps that make it and so computed a second time, inlined
    spread = spread.select(*keys, "ws", F.explode_outer("v").alias("f")).withColumns({"dh": F.shiftright("f", PLACE), "at": at})
    first = F.col("at") - F.col("off")
    if fits:
        found = spread.join(F.broadcast(one), (F.col("dh") == F.col("bh")) & (first >= 0) & (F.array_join(F.slice("ws", F.greatest(first, F.lit(0)) + 1, F.col("n")), " ") == F.col("window")))
    else:
        before = F.least(F.col("at"), F.lit(window - k))
        near = spread.withColumns({"near": F.slice("ws", F.col("at") - before + 1, F.lit(2 * window - k)), "before": before}).drop("ws", "f")
        found = near.join(one, (F.col("dh") == F.col("bh")) & (F.col("before") >= F.col("off")) & (F.array_join(F.slice("near", F.greatest(F.col("before") - F.col("off"), F.lit(0)) + 1, F.col("n")), " ") == F.col("window")))
    found = found.select(*keys, first.alias("s"), "n", "window")
    per_doc = found.groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("s", "n", "window"))).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, p: F.struct(F.greatest(acc["end"], p["s"] + p["n"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), p["s"] + p["n"] - F.greatest(p["s"], acc["end"]))).alias("n"))
    n_hit = F.aggregate("spans", start, step, lambda acc: acc["n"]).cast("long")
    per_doc = per_doc.select(*keys, n_hit.alias("n_hit"), F.explode_outer(F.array_distinct(F.col("spans.window"))).alias("window"))
    owners = each.select("item", F.col("window").alias("w2"))
    named = per_doc.join(F.broadcast(owners) if fits else owners, F.col("window") == F.col("w2"))
    return named.groupBy(*keys).agg(F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))


def judged(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", per_hit: int = 20, **options) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items and contaminated (n_hit > 0 and per_hit * n_hit >= n_words)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(body).alias("_text"), body.alias("_body"))
    found = hits(whole.select("_id", "_text", "_body"), items, ["_id", "_text"], "_body", **options)
    found = found.select(F.col("_id").alias("_fid"), F.col("_text").alias("_ftext"), "n_hit", F.col("items").alias("_items"))
    out = whole.select("_row", "_id", "_text", F.regexp_count(ascii_lower(F.col("_body")), F.lit(TOKEN)).cast("long").alias("n_words"))
    out = out.join(found, F.col("_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ftext")), "left")
    n_hit, owners = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("_items", F.array().cast("array<string>"))
    added = {"n_words": F.col("n_words"), "n_hit": n_hit, "items": owners, "n_items": F.size(owners).cast("long"), "contaminated": (n_hit > 0) & (per_hit * n_hit >= F.col("n_words"))}
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *[value.alias(name) for name, value in added.items()])


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    body = F.coalesce(F.col("text"), F.lit(""))
    found = hits(docs.withColumn("_text", F.xxhash64(body)), table(spark, sf_dir, "benchmark", "item_id", "text"), ["doc_id", "_text"])
    found = found.select(F.col("doc_id").alias("_fid"), F.col("_text").alias("_ftext"), "n_hit", "items")
    out = docs.select("doc_id", F.xxhash64(body).alias("_text"), F.regexp_count(ascii_lower(body), F.lit(TOKEN)).cast("long").alias("n_words"))
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("_fid")) & (F.col("_text") == F.col("_ftext")), "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    contaminated = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated.alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[p0 : p0 + least(len(ws), 13) - 1], ' ') AS win
       FROM (SELECT item, ws, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS p0 FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p0, array_to_string(ws[p0 : p0 + n - 1], ' ') AS win
       FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p0 FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT DISTINCT dw.r, dw.n, dw.p0, bw.item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p0, p0 + n)) AS p FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""
