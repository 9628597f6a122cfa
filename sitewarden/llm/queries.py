"""The queries op1_ to op13_, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, embedding_dedup, fill_middle, fingerprints, language_id, license_scan, line_dedup, minhash, mixing, token_align, token_pack, url_filter, warc
from ._shared import saved, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = saved(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")), "edited-fingerprints")
    return fingerprints.with_near_counts(prints)


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = warc.resolve_revisits(saved(warc.captures_of(pages), "warc-records"))
    headers = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "; ")
    return out.select(F.expr("record_id div 2").alias("page_id"), "record_id", "url_key", "ref_id", "outcome", "status", headers.alias("headers"), "digest")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_pack.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def _license_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    k, lower = license_scan.GRAM, f"translate(%s, '{license_scan.UPPER}', '{license_scan.LOWER}')"
    words = f"regexp_extract_all({lower}, '{license_scan.WORD}')"
    templates = ", ".join(f"({i}, {quoted(label)}, {quoted(text)})" for i, (label, text) in enumerate(license_scan.TEMPLATES))
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS place, {quoted(label)} AS label FROM w, unnest(range(1, len(ws) + 1)) AS u(i) WHERE ws[i:i + {len(p.split(' ')) - 1}] = {p.split(' ')}" for p, label in license_scan.PHRASES)
    return f"""
WITH w AS (SELECT doc_id, {words % "coalesce(text, '')"} AS ws FROM documents),
t AS (SELECT tpl, label, {words % "text"} AS ws FROM (VALUES {templates}) AS v(tpl, label, text)),
g AS (SELECT tpl, label, len(ws) AS m, i - 1 AS tpl_pos, array_to_string(ws[i:i + {k - 1}], ' ') AS gram FROM t, unnest(range(1, len(ws) - {k - 2})) AS u(i)),
d AS (SELECT doc_id, i - 1 AS doc_pos, array_to_string(ws[i:i + {k - 1}], ' ') AS gram FROM w, unnest(range(1, len(ws) - {k - 2})) AS u(i)),
h AS (SELECT DISTINCT doc_id, tpl, label, m, doc_pos, tpl_pos, doc_pos - tpl_pos AS diagonal FROM d JOIN g USING (gram)),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal, doc_pos) <= {license_scan.DRIFT} THEN 0 ELSE 1 END AS new FROM h),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, tpl ORDER BY diagonal, doc_pos) AS cluster FROM n),
s AS (SELECT doc_id, tpl, label, m, cluster, tpl_pos, min(doc_pos) AS low, max(doc_pos) AS high FROM c GROUP BY ALL),
e AS (SELECT *, least({k}, coalesce(tpl_pos - lag(tpl_pos) OVER (PARTITION BY doc_id, tpl, cluster ORDER BY tpl_pos), {k})) AS adds FROM s),
v AS (SELECT doc_id, tpl, label, m, cluster, min(low) AS b, max(high) + {k} AS f, sum(adds) AS covered FROM e GROUP BY ALL),
r AS (SELECT * FROM v WHERE 100 * covered >= {license_scan.PERCENT} * m AND 2 * (f - b) <= 3 * m),
best AS (SELECT doc_id, max(covered / m) AS score FROM r x WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = x.doc_id AND o.b < x.f AND x.b < o.f AND (o.covered > x.covered OR (o.covered = x.covered AND o.m < x.m))) GROUP BY 1),
own AS (SELECT doc_id, label FROM r x WHERE NOT EXISTS (SELECT 1 FROM r o WHERE o.doc_id = x.doc_id AND o.b < x.f AND x.b < o.f AND (o.covered > x.covered OR (o.covered = x.covered AND o.m < x.m)))),
p AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION ALL SELECT doc_id, label FROM own) GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, base.lo AS first_word, base.hi AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
  greatest(coalesce(best.score, 0.0), CASE WHEN base.n > 0 THEN {license_scan.NAMED} ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN every ON every.doc_id = w.doc_id LEFT JOIN best ON best.doc_id = w.doc_id"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_revisits": rf"""
WITH p AS (SELECT page_id AS p, url, coalesce(html, '') AS html, regexp_replace(url, '#.*$', '') AS bare FROM pages),
c AS (
  SELECT p * 2 AS id, url, p * 10 AS at, true AS full_, CASE WHEN p % 13 <> 6 THEN '"' || md5(html) || '"' END AS etag,
    CASE WHEN p % 13 <> 6 THEN 'day ' || (p % 365) END AS lm, 't' || (p * 10) AS dt, CASE WHEN p % 13 <> 6 THEN 'sha256:' || sha256(html) END AS dg, strlen(html)::VARCHAR AS len FROM p
  UNION ALL
  SELECT p * 2 + 1, CASE p % 3 WHEN 0 THEN bare || '#again' WHEN 1 THEN bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'utm_source=feed' ELSE regexp_replace(bare, '^https?://', 'https://') END,
    CASE WHEN p % 11 = 5 THEN p * 10 - 7 ELSE p * 10 + 86400 END, false,
    CASE WHEN p % 5 = 1 THEN NULL WHEN p % 7 = 3 THEN '"changed"' ELSE 'W/"' || md5(html) || '"' END, CASE WHEN p % 5 = 1 THEN 'day ' || (p % 365) END, 't' || (p * 10 + 86400), NULL, '0' FROM p),
r AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest FROM c),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{warc.TRACKING}'))), '&') AS query FROM r),
k AS (SELECT *, base || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM h),
j AS (SELECT v.*, (SELECT max({{'at': o.at, 'id': o.id}}) FROM k o WHERE o.full_ AND o.url_key = v.url_key AND o.at < v.at).id AS ref_id FROM k v WHERE NOT v.full_),
m AS (SELECT j.*, o.etag AS oe, o.lm AS ol, o.dt AS od, o.dg AS og, o.len AS olen,
    coalesce(regexp_replace(j.etag, '^W/', '') = regexp_replace(o.etag, '^W/', ''), j.lm = o.lm, j.dg = o.dg) AS agrees FROM j LEFT JOIN k o ON o.id = j.ref_id),
n AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'no_response' WHEN agrees THEN 'resolved' WHEN NOT agrees THEN 'mismatch' ELSE 'unverified' END AS outcome FROM m)
SELECT id // 2 AS page_id, id AS record_id, url_key, ref_id, outcome, CASE WHEN outcome = 'resolved' THEN 200 END AS status,
  CASE WHEN outcome = 'resolved' THEN 'content-length: ' || olen || '; content-type: text/html; date: ' || dt || CASE WHEN coalesce(etag, oe) IS NULL THEN '' ELSE '; etag: ' || coalesce(etag, oe) END
    || CASE WHEN coalesce(lm, ol) IS NULL THEN '' ELSE '; last-modified: ' || coalesce(lm, ol) END END AS headers,
  CASE WHEN outcome = 'resolved' THEN og END AS digest FROM n""",
        "op5_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.id WHERE e.b > r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id, n.n""",
        "op8_line_dedup": r"""
WITH l AS (SELECT doc_id, i, ls[i] AS line, len(ls) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) t, unnest(range(1, len(ls) + 1)) AS u(i)),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.first_doc AS gone FROM k LEFT JOIN f ON f.key = k.key)
SELECT doc_id, max(n)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
        "op12_license_scan": _license_sql(),
        "op13_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS d FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:i], '') AS pre, array_to_string(u[i + 1:j], '') AS mid, array_to_string(u[j + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
    }
