"""op8: url rules over pages."""

from .common import table
from .url_filter import rules_frame, url_filter


def op8_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLE = {
    "op8_url_filter": r"""
WITH rules(rule, rh, rp, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
p AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT page_id, host, path, rule, verdict,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST, length(rh) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
