"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, languages, mixing, quality, secrets, sharding, simhash, substrings, tokenfiles, urls

QUERIES = {
    "op1_filter_urls": urls.op1_filter_urls,
    "op2_scan_secrets": secrets.op2_scan_secrets,
    "op3_token_files": tokenfiles.op3_token_files,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_shard_documents": sharding.op5_shard_documents,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_identify_languages": languages.op10_identify_languages,
}

# Where SQL can say it. The other operators depend on a hash, a fitted model or a file format; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_filter_urls": """
WITH parts AS (
  SELECT page_id, CASE WHEN STRPOS(COALESCE(url, ''), '://') > 0 THEN SUBSTR(url, STRPOS(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, REGEXP_EXTRACT(rest, '^[^/?#]*') AS raw, rest FROM parts
), urls AS (
  SELECT page_id, TRANSLATE(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    REGEXP_EXTRACT(SUBSTR(rest, LENGTH(raw) + 1), '^[^?#]*') AS path FROM cut
), rules (action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT page_id, host, path, rule_host || rule_path AS rule, action,
    ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY LENGTH(rule_host || rule_path) DESC) AS place
  FROM urls JOIN rules ON (host = rule_host OR ENDS_WITH(host, '.' || rule_host)) AND STARTS_WITH(path, rule_path)
)
SELECT u.page_id, u.host, u.path, f.rule, COALESCE(f.action, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.place = 1
""",
}
