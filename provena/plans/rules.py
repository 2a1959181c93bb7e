"""Queries on ledger rules, URLs and private content over the given tables, with DuckDB oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from provena.functions import paths, privacy, urls
from provena.operators import ledger
from provena.plans import tables as t

AS_OF = "2000-12-31"


def ledger_faults(spark, sf):
    rows = t.ledger(spark, sf)
    return rows.select("o_orderkey", F.array_join(ledger.faults(AS_OF, urls.any_url_key(F.col("evidence_url"))), ",").alias("faults"))


def ledger_counts(spark, sf):
    return ledger.counts(t.ledger(spark, sf).withColumn("subject_key", paths.subject_key(F.col("subject"))))


def ledger_doubles(spark, sf):
    return ledger.doubles(t.ledger(spark, sf).withColumn("url_key", urls.any_url_key(F.col("evidence_url"))), "id", "subject", "url_key")


def url_keys(spark, sf):
    p = t.read(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", urls.native_url_key(F.col("url")).alias("key"), urls.url_key(F.col("url")).alias("exact_key"))


def strict_dates(spark, sf):
    o = t.read(spark, sf, "orders", "o_orderkey", "o_orderdate").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", F.date_format(urls.iso_date(F.col("d")), "yyyyMMdd").alias("day"), urls.iso_date(F.replace("d", F.lit("-0"), F.lit("-"))).isNotNull().alias("loose_is_date"))


def privacy_categories(spark, sf):
    d = t.scanned_texts(spark, sf)
    return d.select("doc_id", F.array_join(privacy.categories(F.col("text")), ",").alias("categories"), privacy.scannable(F.coalesce("text", F.lit(""))).alias("scannable"))


def private_networks(spark, sf):
    d = t.scanned_texts(spark, sf).select("doc_id", F.explode(privacy.addresses(F.col("text"))).alias("address"))
    number = privacy.address_number(F.col("address"))
    return d.select("doc_id", "address", number.alias("number"), privacy.private_address(number).alias("private"))


def category_counts(spark, sf):
    d = t.scanned_texts(spark, sf)
    return d.select("source", F.explode(privacy.categories(F.col("text"))).alias("category")).groupBy("source", "category").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ledger_faults, ledger_counts, ledger_doubles, url_keys, strict_dates, privacy_categories, private_networks, category_counts)}

_off = lambda place: f"({t.digit_sql(place)} = 0)"
_REC = f"""rec AS (SELECT *, CASE WHEN {_off(11)} OR v = 3 THEN NULL WHEN v = 2 THEN 'https://8.8.8.8/' || right(o_orderkey::VARCHAR, 3) ELSE 'https://example.org/orders/' || right(o_orderkey::VARCHAR, 3) END AS url_key FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m, {t.digit_sql(12, "md5(o_orderkey::VARCHAR)")} % 4 AS v,
    CASE WHEN {t.digit_sql(1, "md5(o_orderkey::VARCHAR)")} = 0 THEN 'ext-' ELSE 'EXT-' END || CASE WHEN {t.digit_sql(2, "md5(o_orderkey::VARCHAR)")} = 0 THEN '1066' ELSE strftime(o_orderdate, '%Y') END || '-' || lpad(right(o_orderkey::VARCHAR, 4), 4, '0') AS id,
    CASE WHEN {t.digit_sql(3, "md5(o_orderkey::VARCHAR)")} = 0 THEN 'user' ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 'independent_reproduction' WHEN 'MACHINERY' THEN 'third_party_review' WHEN 'HOUSEHOLD' THEN 'independent_user' ELSE 'institutional_adoption' END END AS kind,
    c_name || CASE WHEN {t.digit_sql(4, "md5(o_orderkey::VARCHAR)")} = 0 THEN ' ' ELSE '' END AS subject, o_orderdate::DATE AS d, o_orderstatus = 'P' AS p, CASE WHEN {t.digit_sql(13, "md5(o_orderkey::VARCHAR)")} = 0 THEN 'open' WHEN o_orderstatus = 'P' THEN 'retracted' ELSE 'verified' END AS status
    FROM orders JOIN customer ON o_custkey = c_custkey)),
  days AS (SELECT *, CASE WHEN NOT {_off(9)} THEN d END AS observed, CASE WHEN {_off(10)} THEN d - 1 ELSE d END AS verified, CASE WHEN p THEN CASE WHEN {_off(14)} THEN d - 1 ELSE d END END AS retracted, status = 'retracted' AS gone FROM rec)"""
_SCANNED = f"""k AS (SELECT doc_id, source, coalesce(text, '') || chr(10) || [{", ".join("'" + x + "'" for x in t.PLANTED)}][{t.digit_sql(1, "md5(doc_id::VARCHAR)")} + 1] AS t FROM documents)"""
_NETWORKS = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("100.64.0.0", 10), ("169.254.0.0", 16)]
_WITHIN = " OR ".join(f"n >> {32 - bits} = {sum(int(x) << (24 - 8 * i) for i, x in enumerate(net.split('.'))) >> (32 - bits)}" for net, bits in _NETWORKS)
# an address is a whole run of digits and points; numbers over 255 or with a leading zero make it none
_ADDRESSES = f"""quads AS (SELECT doc_id, a, [x::BIGINT FOR x IN string_split(a, '.')] AS o, list_bool_or([strlen(x) > 1 AND x[1] = '0' FOR x IN string_split(a, '.')]) AS zero
    FROM (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9.]+')) AS a FROM k) WHERE regexp_full_match(a, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}')),
  addresses AS (SELECT doc_id, a, n, coalesce({_WITHIN}, false) AS private FROM (SELECT doc_id, a, CASE WHEN NOT zero AND list_max(o) < 256 THEN o[1] * 16777216 + o[2] * 65536 + o[3] * 256 + o[4] END AS n FROM quads))"""
_CATS = rf"""{_SCANNED}, {_ADDRESSES}, inside AS (SELECT DISTINCT doc_id FROM addresses WHERE private),
  cat AS (SELECT k.doc_id, source, [x FOR x IN [
    CASE WHEN regexp_matches(t, '(?i)[a-z]:[\\/](users|documents and settings)[\\/][^\\/\s]') OR regexp_matches(t, '(?i)/(users|home)/[^/\s]') THEN 'absolute_user_home_path' END,
    CASE WHEN regexp_matches(t, 'github_pat_[A-Za-z0-9_]{{20}}|gh[pousr]_[A-Za-z0-9]{{20}}|sk-[A-Za-z0-9_-]{{20}}|AKIA[A-Z0-9]{{16}}') THEN 'credential_token_shape' END,
    CASE WHEN len([v FOR v IN regexp_extract_all(t, '(?i)"(platform_details|os_description)"\s*:\s*"([^"]+)"', 2) IF lower(trim(v)) NOT IN ('aix', 'darwin', 'freebsd', 'linux', 'netbsd', 'openbsd', 'testos', 'unknown', 'windows')]) > 0 THEN 'exact_host_platform_metadata' END,
    CASE WHEN len([v FOR v IN regexp_extract_all(t, '(?i)"timezone"\s*:\s*"([^"]+)"', 1) IF lower(trim(v)) NOT IN ('utc', 'etc/utc', 'gmt', 'z')]) > 0
      OR len([v FOR v IN regexp_extract_all(t, '(?i)\b(utc|gmt)\s*[+-]\s*([0-9]{{1,2}}(:?[0-9]{{2}})?)\b', 2) IF regexp_matches(v, '[1-9]')]) > 0
      OR len([v FOR v IN regexp_extract_all(t, '\b[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}}([.][0-9]+)?)?[+-]([0-9]{{2}}:?[0-9]{{2}})\b', 3) IF regexp_matches(v, '[1-9]')]) > 0 THEN 'local_timezone_metadata' END,
    CASE WHEN regexp_matches(t, '(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}\b') THEN 'non_noreply_email' END,
    CASE WHEN contains(t, '-----BEGIN PRIVATE KEY-----') OR contains(t, '-----BEGIN OPENSSH PRIVATE KEY-----') THEN 'private_key_material' END,
    CASE WHEN inside.doc_id IS NOT NULL THEN 'private_or_cgnat_network_address' END] IF x IS NOT NULL] AS c FROM k LEFT JOIN inside ON k.doc_id = inside.doc_id)"""
ORACLES = {
    "ledger_faults": f"""WITH {_REC} SELECT o_orderkey, array_to_string([x FOR x IN [
        CASE WHEN status = 'open' THEN 'status' END, CASE WHEN id LIKE 'ext%' THEN 'id' END, CASE WHEN kind = 'user' THEN 'kind' END, CASE WHEN subject LIKE '% ' THEN 'subject' END, CASE WHEN {_off(5)} THEN 'scope' END,
        CASE WHEN {_off(6)} THEN 'relationship' END, CASE WHEN {_off(7)} THEN 'consent' END, CASE WHEN {_off(8)} THEN 'source_commit' END, CASE WHEN observed IS NULL THEN 'observed_date' END,
        CASE WHEN observed IS NULL OR verified < observed OR verified > DATE '2000-12-31' THEN 'verified_date' END, CASE WHEN id[5:8] <> year(d)::VARCHAR THEN 'id_year' END, CASE WHEN url_key IS NULL THEN 'evidence_url' END,
        CASE WHEN gone AND (retracted < verified OR retracted > DATE '2000-12-31') OR NOT gone AND p THEN 'retracted_date' END,
        CASE WHEN gone AND {_off(15)} OR NOT gone AND p THEN 'retraction_reason' END] IF x IS NOT NULL], ',') AS faults FROM days""",
    "ledger_counts": f"""WITH {_REC} SELECT kind, count(*) FILTER (status <> 'retracted') AS n_records, count(DISTINCT lower(nfc_normalize(subject))) FILTER (status <> 'retracted') AS n_subjects
        FROM rec
        GROUP BY kind""",
    "ledger_doubles": f"""WITH {_REC}, v AS (SELECT id AS value, 'id' AS c
        FROM rec
        UNION ALL SELECT subject, 'subject'
        FROM rec
        UNION ALL SELECT url_key, 'url_key'
        FROM rec) SELECT value, count(*) AS n, c AS "column"
        FROM v
        WHERE value IS NOT NULL
        GROUP BY value, c
        HAVING count(*) > 1""",
    "private_networks": f"WITH {_SCANNED}, {_ADDRESSES} SELECT doc_id, a AS address, n AS number, private FROM addresses",
    "url_keys": r"""WITH k AS (SELECT page_id, CASE WHEN regexp_matches(url, '^https://[^?#]*(#.*)?$') THEN 'https://' || lower(regexp_extract(url, '^https://([^/?#:]+)', 1)) || CASE WHEN regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https://[^/?#]+(/[^?#]*)', 1) END END AS key FROM pages) SELECT page_id, key, key AS exact_key FROM k""",
    "strict_dates": """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y-%m-%d') = replace(strftime(o_orderdate, '%Y-%m-%d'), '-0', '-') AS loose_is_date
        FROM orders""",
    "privacy_categories": f"WITH {_CATS} SELECT cat.doc_id, array_to_string(c, ',') AS categories, true AS scannable FROM cat",
    "category_counts": f"WITH {_CATS} SELECT source, category, count(*) AS n FROM (SELECT source, unnest(c) AS category FROM cat) GROUP BY 1, 2",
}
