"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blocknames, fim, htmltext, hyperminhash, langid, merkle, mixing, packing, pii, quality, secretscan, substring, tokencount


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": lambda spark, d: pii.digest(_documents(spark, d)),
    "op2_substring_dedup": lambda spark, d: substring.digest(_documents(spark, d)),
    "op3_near_dedup": lambda spark, d: hyperminhash.near_duplicates(_documents(spark, d)),
    "op4_language_id": lambda spark, d: langid.digest(_documents(spark, d)),
    "op5_mixing": lambda spark, d: mixing.taken(_documents(spark, d)),
    "op6_token_counts": lambda spark, d: tokencount.token_counts(_documents(spark, d)),
    "op7_html_extraction": lambda spark, d: htmltext.extract(spark.read.parquet(f"{d}/pages.parquet")),
    "op8_quality": lambda spark, d: quality.digest(_documents(spark, d)),
    "op9_exact_dedup": lambda spark, d: blocknames.groups(_documents(spark, d)),
    "op10_packing": lambda spark, d: packing.pack(_documents(spark, d)),
    "op11_merkle": lambda spark, d: merkle.digest(_documents(spark, d)),
    "op12_fim": lambda spark, d: fim.digest(_documents(spark, d)),
    "op13_secrets": lambda spark, d: secretscan.digest(_documents(spark, d)),
}

ORACLE: dict[str, str] = {}

ORACLE["op9_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY plain ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY plain) AS group_size,
       row_number() OVER (PARTITION BY plain ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(plain) AS text_sha256
FROM t
"""

#: RE2 forms of the patterns; a span is cut out by splitting at the matches, as positions aren't given. g[i] is the text
#: before match m[i], whose end holds the context words.
_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda p: least(TRY_CAST(p AS HUGEINT), 256))) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", "length(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, 21), lambda i: CASE WHEN i % 2 = 0 THEN TRY_CAST(lpad(regexp_replace(m, '[ -]', '', 'g'), 20, '0')[i] AS INT) ELSE (2 * TRY_CAST(lpad(regexp_replace(m, '[ -]', '', 'g'), 20, '0')[i] AS INT)) // 10 + (2 * TRY_CAST(lpad(regexp_replace(m, '[ -]', '', 'g'), 20, '0')[i] AS INT)) % 10 END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
    "iban": (r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "list_reduce(list_prepend(0, list_transform(string_split(array_to_string(list_transform(string_split(replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4], ''), lambda c: CASE WHEN c >= 'A' THEN CAST(unicode(c) - 55 AS VARCHAR) ELSE c END), ''), ''), lambda c: CAST(c AS INT))), lambda r, c: (r * 10 + c) % 97) = 1"),
    "secret": (r"[A-Za-z0-9+/_=-]{20,}", "regexp_matches(m, '[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 8 AND score >= 0.75"),
    "ssn": (r"[0-9]+(?:-[0-9]*)*", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND before <> '-' AND score >= 0.75"),
}


def _pii_sql() -> str:
    ok = " ".join(f"WHEN kind = '{k}' THEN {c}" for k, (_, c) in _KINDS.items())
    every = " UNION ALL ".join(
        f"""SELECT doc_id, {at} AS k, '{kind}' AS kind, m[i] AS m, right(g[i], 1) AS before,
      {pii.PATTERN_SCORE + pii.CHECK_SCORE[kind]} + CASE WHEN regexp_matches(lower(right(g[i], 40)), '(?:^|[^a-z])(?:{pii.CONTEXT[kind]})') THEN 0.2 ELSE 0 END AS score,
      list_sum(list_transform(range(1, i + 1), lambda j: length(g[j]))) + coalesce(list_sum(list_transform(range(1, i), lambda j: length(m[j]))), 0) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g, unnest(range(1, len(regexp_extract_all(t, '{pattern}')) + 1)) AS i FROM docs)"""
        for at, (kind, (pattern, _)) in enumerate(_KINDS.items())
    )
    count = lambda k: f"coalesce(n_{k}, 0) AS n_{k}"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (SELECT doc_id, k, kind, s, score, kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT) AS span FROM ({every}) WHERE CASE {ok} END),
per AS (
  SELECT doc_id, count(*) AS n_spans, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.PATTERNS)},
         string_agg(span, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(span, ',' ORDER BY k, s) AS spans,
         string_agg(printf('%.1f', CAST(score AS DOUBLE)), ',' ORDER BY k, s) AS scores
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(count(k) for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores, {", ".join(count(k) for k in pii.PATTERNS if k not in pii.BASE)}, coalesce(n_spans, 0) AS n_spans
FROM docs d LEFT JOIN per USING (doc_id)
"""


ORACLE["op1_pii"] = _pii_sql()

ORACLE["op2_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM hit),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM (SELECT words.* FROM words ANTI JOIN gone USING (doc_id, j)) GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

ORACLE["op3_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: array_to_string(w[i:i + 3], ' '))) AS s FROM w WHERE len(w) > 0),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT u, v FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.v FROM reach JOIN edges ON reach.b = edges.u)
SELECT a AS doc_id, coalesce(any_value(len(s.s)), 0) AS n_shingles, min(b) AS component_id, min(b) = a AS kept
FROM reach LEFT JOIN s ON s.doc_id = a GROUP BY a
"""

ORACLE["op11_merkle"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, CASE WHEN crc32_is_even THEN replace(text, chr(10), '') ELSE text END AS altered,
         concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS head
  FROM (SELECT *, CRC_EVEN AS crc32_is_even FROM documents)),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(altered) || ':' || altered, '-')) AS other FROM d),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
lv AS (
  SELECT 0 AS k, source, pos, n, leaf AS node, '' AS children FROM placed
  UNION ALL
  SELECT k + 1, source, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)), string_agg(node, '' ORDER BY pos)
  FROM lv WHERE n > 1 GROUP BY k, source, pos // 3),
subs AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1),
tops AS (
  SELECT 0 AS k, pos, n, subroot AS node, '' AS children FROM subs
  UNION ALL
  SELECT k + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(node, '' ORDER BY pos)), string_agg(node, '' ORDER BY pos)
  FROM tops WHERE n > 1 GROUP BY k, pos // 3),
low AS (
  SELECT p.source, p.pos, p.leaf, lv.k, left(children, 64 * ((p.pos // CAST(3 ** (lv.k - 1) AS BIGINT)) % 3)) AS before,
         substr(children, 64 * ((p.pos // CAST(3 ** (lv.k - 1) AS BIGINT)) % 3) + 65) AS after
  FROM placed p JOIN lv ON lv.source IS NOT DISTINCT FROM p.source AND lv.k > 0 AND lv.pos = p.pos // CAST(3 ** lv.k AS BIGINT)),
high AS (
  SELECT s.source, tops.k, left(children, 64 * ((s.pos // CAST(3 ** (tops.k - 1) AS BIGINT)) % 3)) AS before,
         substr(children, 64 * ((s.pos // CAST(3 ** (tops.k - 1) AS BIGINT)) % 3) + 65) AS after
  FROM subs s JOIN tops ON tops.k > 0 AND tops.pos = s.pos // CAST(3 ** tops.k AS BIGINT)),
low_proof AS (SELECT source, pos, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '?' || after ORDER BY k) AS steps FROM low GROUP BY source, pos),
high_proof AS (SELECT source, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '?' || after ORDER BY k) AS steps FROM high GROUP BY source),
root AS (SELECT node AS root FROM tops WHERE n = 1),
whole AS (
  SELECT p.doc_id, p.leaf, p.other, s.subroot, root.root, coalesce(l.proof, '') || coalesce(h.proof, '') AS proof,
         list_concat(coalesce(l.steps, []), coalesce(h.steps, [])) AS steps
  FROM placed p CROSS JOIN root JOIN subs s ON s.source IS NOT DISTINCT FROM p.source
  LEFT JOIN low_proof l ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.pos LEFT JOIN high_proof h ON h.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256,
       list_reduce(list_prepend(other, steps), lambda f, x: sha256(replace(x, '?', f))) AS folded_root,
       list_reduce(list_prepend(other, steps), lambda f, x: sha256(replace(x, '?', f))) = root AS verified
FROM whole
"""


def _crc32_even(digits: str) -> str:
    """Whether the crc32 of a string of ASCII is even, in DuckDB, which has no crc32: its last bit is that of a shift
    register over the bits of the string, eight steps a byte."""
    byte = "list_reduce(list_prepend(xor(crc, ord(c)), range(1, 9)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)"
    step = byte.replace("xor(crc, ord(c))", "xor(s, CAST(unicode(chr(CAST(b AS INT))) AS BIGINT))")
    codes = f"list_transform(string_split({digits}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    return f"coalesce(xor(list_reduce(list_prepend(4294967295, {codes}), lambda s, b: {step}), 4294967295) % 2 = 0, false)"


ORACLE["op11_merkle"] = ORACLE["op11_merkle"].replace("CRC_EVEN", _crc32_even("CAST(doc_id AS VARCHAR)"))

ORACLE["op12_fim"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, list_transform([0, 1, 2, 3], lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS x FROM t),
v AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain'
              WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM u)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
                        ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM v
"""
