"""The verdict on every page's url."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import urls
from tidegauge.llm.registry import table

NAME = "op7_url_decisions"
#: Stated rules: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HOST = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), '" + urls.UPPER + "', '" + urls.LOWER + "')"
_PATH = "regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_RULED = """
SELECT url, max_by(rule, size) AS rule, max_by(verdict, size) AS verdict FROM (
  SELECT u.url, r.host || r.path AS rule, r.verdict, length(r.host || r.path) AS size
  FROM {0} u JOIN (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + """) r(verdict, host, path)
  ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) x GROUP BY url"""

ORACLE = f"""
WITH RECURSIVE own AS (
  SELECT page_id, url, html, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path FROM pages),
tags AS (
  SELECT url, host, path, regexp_replace(target, {_quoted(urls.AMPERSAND)}, '&', 'g') AS target FROM (
    SELECT url, host, path, unnest(list_transform(regexp_extract_all(html, {_quoted(urls.CANONICAL_TAG)}), lambda t: regexp_extract(t, {_quoted(urls.HREF)}, 1))) AS target FROM own WHERE url IS NOT NULL
    UNION ALL
    SELECT url, host, path, unnest(list_transform(regexp_extract_all(html, {_quoted(urls.REFRESH_TAG)}), lambda t: regexp_extract(t, {_quoted(urls.REFRESH_URL)}, 1))) FROM own WHERE url IS NOT NULL) t),
placed AS (
  SELECT url, host, target, regexp_extract(target, '(?s)^[^?#]*(.*)$', 1) AS rest,
         CASE WHEN starts_with(target, '/') THEN regexp_extract(target, '(?s)^[^?#]*') WHEN starts_with(target, '?') THEN path
              ELSE coalesce(nullif(regexp_extract(path, '(?s)^.*/'), ''), '/') || regexp_extract(target, '(?s)^[^?#]*') END AS long_path
  FROM tags WHERE target <> '' AND NOT starts_with(target, '#')),
walked AS (
  SELECT *, CASE WHEN starts_with(target, '?') OR NOT regexp_matches(long_path, '/[.][.]?(/|$)') THEN long_path ELSE array_to_string(list_reduce(
         list_transform(string_split(long_path, '/'), lambda s: [s]),
         lambda done, part: CASE WHEN part[1] = '..' THEN done[1:greatest(len(done) - 1, 1)] WHEN part[1] = '.' THEN done ELSE list_concat(done, part) END), '/')
         || CASE WHEN regexp_matches(long_path, '/[.][.]?$') THEN '/' ELSE '' END END AS short_path FROM placed),
direct AS (
  SELECT DISTINCT url AS a, b FROM (
    SELECT url, CASE WHEN starts_with(target, '//') THEN 'https:' || target WHEN regexp_matches(target, {_quoted(urls.ABSOLUTE)}) THEN target
                     WHEN regexp_matches(target, {_quoted(urls.OTHER_SCHEME)}) OR NOT contains(url, '://') THEN NULL
                     ELSE 'https://' || host || short_path || rest END AS b FROM walked) x WHERE b IS NOT NULL),
ends AS (SELECT url FROM own WHERE url IS NOT NULL UNION SELECT b FROM direct),
parsed AS (
  SELECT url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path,
         list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({urls.TRACKING})(=|$)')) AS params
  FROM ends),
normal AS (
  SELECT url AS a, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN 'https://' || regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END ELSE url END AS b FROM parsed),
edges AS (SELECT a, b FROM direct UNION SELECT b, a FROM direct UNION SELECT a, b FROM normal UNION SELECT b, a FROM normal),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
part AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
node_urls AS (SELECT node AS url, {_HOST.format('node')} AS host, {_PATH.format('node')} AS path FROM part),
node_rules AS ({_RULED.format('node_urls')}),
blocked AS (
  SELECT component FROM part JOIN node_rules ON node = url GROUP BY component
  HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')),
own_urls AS (SELECT DISTINCT url, host, path FROM own WHERE url IS NOT NULL),
own_rules AS ({_RULED.format('own_urls')})
SELECT o.page_id, o.host, o.path, r.rule,
       coalesce(r.verdict, CASE WHEN b.component IS NOT NULL THEN 'block' END, 'allow') AS verdict,
       coalesce(p.component, o.url) AS component
FROM own o LEFT JOIN own_rules r ON r.url = o.url LEFT JOIN part p ON p.node = o.url LEFT JOIN blocked b ON b.component = p.component
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)
