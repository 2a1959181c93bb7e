"""Fill-in-middle transformation: native functions only, no shuffle.

A text is cut into units (a run of ASCII letters, or any one other code point). Two cuts, drawn from the SHA-256 of seed and
id, part it into prefix, middle and suffix, which are put in order behind sentinels: psm is prefix, suffix, middle and spm suffix,
prefix, middle. A drawn share of texts stays plain, as does a text that is empty or has a sentinel in it, so the parts of
an output are found again by its sentinels alone.

No occurrence of a sentinel can start in a part and end in the sentinel behind it, because the first character of a sentinel
is found nowhere else in any (checked), and none is the start of another.

Edge cases: a null text is an empty one and has an empty output, not a null one; a null id counts as no digits, so all texts
without id are cut by the same draw; repeated rows get equal results; a text without letters has one unit a code point; an
empty table gives no rows. Columns named as those of the result are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import table

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")


def draw(salt: str, key: Column, place: int) -> Column:
    """The ``place``-th group of eight hex digits of the SHA-256 of salt, colon and key, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * place - 7, 8), 16, 10).cast("long")


def _checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    first = {s[:1] for s in sentinels}
    again = any(c in s[1:] for c in first for s in sentinels)
    if len(sentinels) != 3 or "" in first or again or any(i != j and b.startswith(a) for i, a in enumerate(sentinels) for j, b in enumerate(sentinels)):
        raise ValueError("three sentinels are needed, whose first characters are found nowhere else in them and none of which starts another")
    return tuple(sentinels)


def _split(sentinels: Sequence[str]) -> str:
    return "|".join(re.escape(s) for s in sentinels)


def arranged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, rate: int = 90, spm: int = 20, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """``docs`` with n (units), form (plain, psm or spm), output, prefix_chars and middle_chars (null if plain).

    Of a hundred texts ``rate`` are rearranged, and of a hundred of these ``spm`` put the suffix first."""
    p, s, m = _checked(sentinels)
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_body"), F.col(f"`{id_col}`").alias("_id"))
    # each step is a projection of its own: what the next one names more than once is then computed once
    out = out.withColumns({"_units": F.regexp_extract_all("_body", F.lit(UNIT), F.lit(0)), **{f"_h{i}": draw(str(seed), F.col("_id"), i) for i in range(1, 5)}})
    out = out.withColumn("n", F.size("_units").cast("long"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.contains("_body", F.lit(p)) | F.contains("_body", F.lit(s)) | F.contains("_body", F.lit(m)) | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm, "spm").otherwise("psm")
    out = out.withColumns({"_from": F.least(a, b).cast("int"), "_to": F.greatest(a, b).cast("int"), "form": form})
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start + 1, length), ""))
    first, end, n = F.col("_from"), F.col("_to"), F.size("_units")
    out = out.withColumns({"_prefix": part(F.lit(0), first), "_middle": part(first, end - first), "_suffix": part(end, n - end)}).drop("_units")
    psm = F.concat(F.lit(p), F.col("_prefix"), F.lit(s), F.col("_suffix"), F.lit(m), F.col("_middle"))
    swapped = F.concat(F.lit(s), F.col("_suffix"), F.lit(p), F.col("_prefix"), F.lit(m), F.col("_middle"))
    output = F.when(F.col("form") == "plain", F.col("_body")).when(F.col("form") == "spm", swapped).otherwise(psm)
    added = {"n": F.col("n"), "form": F.col("form"), "output": output, "prefix_chars": F.char_length("_prefix").cast("long"), "middle_chars": F.char_length("_middle").cast("long")}
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in added], *[value.alias(name) for name, value in added.items()])


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text an output was made of; null for an output that doesn't have the sentinels of its form, each once and in order."""
    p, s, m = _checked(sentinels)
    parts = F.split(output, _split(sentinels), -1)
    order = F.regexp_extract_all(output, F.lit(_split(sentinels)), F.lit(0))
    whole = lambda *names: (order == F.array(*[F.lit(x) for x in names])) & (F.get(parts, 0) == "")
    psm = F.when(whole(p, s, m), F.concat(F.get(parts, 1), F.get(parts, 3), F.get(parts, 2)))
    spm = F.when(whole(s, p, m), F.concat(F.get(parts, 2), F.get(parts, 3), F.get(parts, 1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arranged(table(spark, sf_dir, "documents", "doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
