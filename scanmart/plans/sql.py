"""Oracle SQL per registered query key."""

from __future__ import annotations

from scanmart.plans.oracle import ACCOUNTS, ADAPTER, ORGS, SCORED, SIGNALS, with_ctes

ORACLE: dict[str, str] = {}

ORACLE["observations"] = with_ctes(ADAPTER) + "SELECT * EXCLUDE (user_id, k) FROM obs"
ORACLE["accounts_mart"] = with_ctes(ADAPTER, ACCOUNTS) + "SELECT * FROM accounts"
ORACLE["services_mart"] = with_ctes(ADAPTER) + """
SELECT d.domain AS account_id, d.domain, s.service, count(*) AS observation_count,
       min(try_cast(o.timestamp AS TIMESTAMP)) AS first_seen, max(try_cast(o.timestamp AS TIMESTAMP)) AS last_seen
FROM obs AS o CROSS JOIN UNNEST(o.registrable_domains) AS d(domain) CROSS JOIN UNNEST(o.detected_services) AS s(service)
WHERE d.domain IS NOT NULL
GROUP BY d.domain, s.service"""
_MANY = """obs_many AS (SELECT * REPLACE (
  list_transform(registrable_domains, lambda d: d || '-' || ip_str || '-' || event_id % 20) AS registrable_domains) FROM obs)"""
_MANY_ACCOUNTS = ACCOUNTS.replace("FROM obs", "FROM obs_many")
ORACLE["accounts_mart_many"] = with_ctes(ADAPTER, _MANY, _MANY_ACCOUNTS) + "SELECT * FROM accounts"
ORACLE["top_accounts_many"] = with_ctes(ADAPTER, _MANY, _MANY_ACCOUNTS, SCORED) + """
SELECT domain, opportunity_score FROM scored ORDER BY opportunity_score DESC, domain LIMIT 1000"""
ORACLE["org_mart"] = with_ctes(ADAPTER, ORGS) + """
SELECT canonical_org, count(*) AS observation_count, count(DISTINCT ip_str) AS unique_ip_count,
       max(timestamp) AS last_observed_at
FROM obs_orgs WHERE canonical_org IS NOT NULL GROUP BY canonical_org"""
ORACLE["org_ips"] = with_ctes(ADAPTER, ORGS) + """
SELECT DISTINCT canonical_org, ip_str AS ip FROM obs_orgs WHERE canonical_org IS NOT NULL AND ip_str IS NOT NULL"""
ORACLE["account_signals"] = with_ctes(ADAPTER, ACCOUNTS, SIGNALS) + "SELECT * FROM signals"
ORACLE["scored_accounts"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + "SELECT * FROM scored"
ORACLE["qualified_accounts"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + \
    "SELECT domain, opportunity_score FROM scored WHERE coalesce(opportunity_score, 0) >= 60"
ORACLE["score_distribution"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT count(*) AS accounts, min(opportunity_score) AS min_score, round(avg(opportunity_score), 2) AS avg_score,
       max(opportunity_score) AS max_score FROM scored"""

# ------------------------------------------------------------------ ranking, evidence, context
from scanmart.plans.oracle import KEYWORD_SQL, SEARCH_SQL  # noqa: E402

_TOP = "sel AS (SELECT * FROM scored ORDER BY opportunity_score DESC, domain LIMIT 1000)"
_EVID = """ev AS (SELECT unnest(registrable_domains) AS domain, observation_id, timestamp, ip_str, port, service_category,
                  vuln_count, vuln_max_cvss, cloud_provider, detected_technologies FROM obs),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY domain ORDER BY vuln_max_cvss DESC NULLS LAST,
                  timestamp DESC, observation_id) AS INTEGER) AS evidence_rank
           FROM ev WHERE domain IN (SELECT domain FROM sel))"""
_METRICS = ", ".join(["observation_count", "unique_ip_count", "unique_hostname_count", "unique_port_count",
                      "unique_service_count", "vulnerability_count", "critical_vulnerability_observations",
                      "high_vulnerability_observations", "eol_observation_count", "exposed_database_count",
                      "exposed_remote_access_count", "cloud_observation_count", "identified_cloud_observation_count",
                      "icp_score", "exposure_score", "vulnerability_score", "technology_score", "recency_score",
                      "opportunity_score"])

ORACLE["top_accounts"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, _TOP) + "SELECT * FROM sel"
ORACLE["ranked_signals"] = with_ctes(ADAPTER, ACCOUNTS, SIGNALS) + """
SELECT *, CASE WHEN severity = 'critical' THEN 1 WHEN severity = 'high' THEN 2 ELSE 3 END AS severity_rank FROM signals"""
ORACLE["account_evidence"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, _TOP, _EVID) + \
    "SELECT * FROM ranked WHERE evidence_rank <= 5"
ORACLE["account_context"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SIGNALS, _TOP, _EVID) + f"""
, sig AS (SELECT domain, list(signal_id ORDER BY severity, signal_name) AS signal_ids FROM signals
         WHERE domain IN (SELECT domain FROM sel) GROUP BY domain),
evd AS (SELECT domain, list(observation_id ORDER BY evidence_rank) AS ids FROM ranked WHERE evidence_rank <= 5 GROUP BY domain)
SELECT sel.domain, account_id, first_seen, last_seen, {_METRICS},
       coalesce(sig.signal_ids, CAST([] AS VARCHAR[])) AS signal_ids,
       coalesce(evd.ids, CAST([] AS VARCHAR[])) AS evidence_observation_ids
FROM sel LEFT JOIN sig ON sig.domain = sel.domain LEFT JOIN evd ON evd.domain = sel.domain"""

ORACLE["radar_filter"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT domain, opportunity_score FROM scored
WHERE contains(lower(coalesce(domain, '')), 'example')
  AND coalesce(opportunity_score, 0) BETWEEN 40.0 AND 100.0
  AND coalesce(len(list_intersect(countries, ['NATION_1', 'NATION_2'])) > 0, false)
  AND coalesce(cloud_observation_count, 0) <> 0
  AND coalesce(vulnerability_count, 0) >= 0
  AND coalesce(eol_observation_count, 0) > 0"""
ORACLE["radar_rows"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT domain, opportunity_score FROM scored
WHERE contains(lower(coalesce(domain, '')), 'example') AND coalesce(opportunity_score, 0) BETWEEN 40.0 AND 100.0
ORDER BY coalesce(opportunity_score, 0) DESC, domain LIMIT 25"""
ORACLE["icp_industry"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT domain, CASE length(domain) % 3 WHEN 0 THEN 100.0 WHEN 1 THEN 25.0 ELSE icp_score END AS icp_score FROM scored"""
ORACLE["country_facet"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT country, count(*) AS accounts FROM (SELECT unnest(countries) AS country FROM scored) WHERE country IS NOT NULL
GROUP BY country ORDER BY accounts DESC, country LIMIT 30"""
ORACLE["quick_stats"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT count(*) AS matching_accounts,
       count(*) FILTER (WHERE coalesce(critical_vulnerability_observations, 0) > 0) AS critical_signals,
       count(*) FILTER (WHERE coalesce(cloud_observation_count, 0) <> 0) AS cloud_observed,
       round(avg(coalesce(opportunity_score, 0.0)), 1) AS avg_opportunity_score FROM scored"""

for _k, _q in {"search_keyword": "exposed mysql database", "search_domain": "example.com",
               "search_fallback": "zzqx qqzv"}.items():
    ORACLE[_k] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SEARCH_SQL(_q)) + "SELECT domain, opportunity_score FROM found"

ORACLE["explore_evidence"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SEARCH_SQL("exposed mysql database")) + """
, f25 AS (SELECT * FROM found ORDER BY coalesce(opportunity_score, 0) DESC, domain LIMIT 25)
SELECT domain, round(coalesce(opportunity_score, 0), 1) AS opportunity_score,
  coalesce(vulnerability_count, 0) AS vulnerability_count, coalesce(critical_vulnerability_observations, 0) AS critical,
  coalesce(exposed_database_count, 0) AS exposed_databases, coalesce(exposed_remote_access_count, 0) AS remote_access,
  coalesce(eol_observation_count, 0) AS eol, coalesce(cloud_observation_count, 0) AS cloud,
  list_filter(countries, lambda c: c IS NOT NULL AND c <> '')[1] AS country
FROM f25"""

ORACLE["explore_pack"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SEARCH_SQL("exposed mysql database")) + """
, f25 AS (SELECT * FROM found ORDER BY coalesce(opportunity_score, 0) DESC, domain LIMIT 25)
SELECT 'exposed mysql database' AS question,
  list(domain ORDER BY coalesce(opportunity_score, 0) DESC, domain) AS domains,
  list(coalesce(critical_vulnerability_observations, 0) ORDER BY coalesce(opportunity_score, 0) DESC, domain) AS critical,
  ['Only use domains from shortlist', 'Do not invent firmographics'] AS constraints FROM f25"""
ORACLE["search_batch"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + f"""
, q AS (SELECT conv_id * 100000 + turn AS question_id,
               lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS q FROM conversations WHERE role = 'user'),
qt AS (SELECT question_id, q, list_filter(regexp_split_to_array(q, '[^a-z0-9.\\-]+'), lambda t: len(t) > 0) AS toks FROM q),
sh AS (SELECT *, coalesce(opportunity_score, 0.0) AS score,
              lower(coalesce(domain, '') || ' ' || coalesce(array_to_string(countries, ' '), '')) AS hay FROM scored),
m AS (SELECT qt.question_id, sh.domain, sh.score FROM qt, sh
      WHERE (len(qt.q) > 0 AND contains(lower(coalesce(sh.domain, '')), qt.q))
         OR len(list_filter(qt.toks, lambda x: contains(x, '.') AND contains(lower(coalesce(sh.domain, '')), x))) > 0
         OR len(list_filter(qt.toks, lambda x: len(x) >= 3 AND contains(sh.hay, x))) > 0
         OR {KEYWORD_SQL('qt.q', 'sh.')}),
pool AS (SELECT * FROM m UNION ALL
         SELECT q.question_id, sh.domain, sh.score FROM q, sh
         WHERE q.question_id NOT IN (SELECT question_id FROM m))
SELECT question_id, CAST(rn AS INTEGER) AS search_rank, domain, score AS opportunity_score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, domain) AS rn FROM pool) WHERE rn <= 80"""

ORACLE["display_columns"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
, dd AS (SELECT *, greatest(0, CAST(floor((epoch_us(reference_time) - epoch_us(last_seen)) / 86400e6) AS INTEGER)) AS days,
         list_filter([CASE WHEN coalesce(critical_vulnerability_observations,0) <> 0 THEN 'Critical' END,
                      CASE WHEN coalesce(exposed_database_count,0) <> 0 THEN 'Exposed DB' END,
                      CASE WHEN coalesce(exposed_remote_access_count,0) <> 0 THEN 'Remote' END,
                      CASE WHEN coalesce(eol_observation_count,0) <> 0 THEN 'EOL' END], lambda t: t IS NOT NULL) AS tags
         FROM scored, ref)
SELECT domain,
  coalesce(list_filter(countries, lambda c: c IS NOT NULL AND c <> '')[1], '—') AS primary_country,
  CASE WHEN len(tags) = 0 THEN '—' ELSE array_to_string(tags, ' · ') END AS signal_summary,
  CASE WHEN last_seen IS NULL THEN '—' WHEN days = 0 THEN 'today' WHEN days = 1 THEN '1 day ago'
       WHEN days < 90 THEN days || ' days ago' ELSE substr(CAST(last_seen AS VARCHAR), 1, 19) END AS last_seen_label,
  CASE WHEN coalesce(opportunity_score,0) >= 80 THEN 'high' WHEN coalesce(opportunity_score,0) >= 65 THEN 'medium'
       ELSE 'low' END AS score_band
FROM dd"""

# ------------------------------------------------------------------ raw records: parse, normalize, profile
from scanmart.functions import constants as _K  # noqa: E402
from scanmart.plans.oracle import ORGS  # noqa: E402

_REC = """rec AS (SELECT *, len(registrable_domains) AS n_domains, port IS NOT NULL AS has_port FROM obs_orgs)"""
_RC = ", ".join(["observation_id", "timestamp", "ip_str", "hostname", "registrable_domains", "port",
                 "service_category", "country_code", "cloud_present", "cloud_provider", "vuln_count",
                 "vuln_max_cvss", "has_eol_tag", "detected_technologies", "detected_services",
                 "database_service_count", "remote_access_service_count", "canonical_org"])
ORACLE["records_observations"] = with_ctes(ADAPTER, ORGS) + \
    f"SELECT {_RC.replace('hostname,', "regexp_replace(hostname, '^www[.]', '') AS hostname,")} FROM obs_orgs"

ORACLE["simple_observations"] = with_ctes(ADAPTER, ORGS) + """
SELECT ip_str AS ip, list_transform(registrable_domains, lambda x: lower(x)) AS domains,
  [regexp_replace(hostname, '^www[.]', '')] AS hostnames,
  registrable_domains, service_category, canonical_org, port,
  CASE WHEN has_eol_tag THEN '["eol-product"]' ELSE '[]' END AS tags,
  CASE WHEN cloud_present THEN '{"provider":' || coalesce('"' || cloud_provider || '"', 'null') || '}' ELSE 'null' END AS cloud,
  '{"country_code":"' || country_code || '"}' AS location, timestamp
FROM obs_orgs"""

ORACLE["signal_counts"] = with_ctes(ADAPTER, ORGS) + """
SELECT timestamp, ip_str AS ip, CASE WHEN coalesce(port, 0) <> 0 THEN 1.0 ELSE 0.0 END AS exposure,
  CASE WHEN vuln_count > 0 THEN 1.0 ELSE 0.0 END AS vulnerability, 0.0 AS technology FROM obs_orgs"""

ORACLE["registrable_domains"] = r"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host, nullif(regexp_extract(regexp_replace(regexp_replace(trim(lower(host)), '\.+$', ''), '^www\.', ''),
       '([^.]+\.example\.(com|org|net))$', 1), '') AS registrable_domain FROM h"""

_SUF = "^(.+?)(( (" + "|".join(_K.ORG_LEGAL_SUFFIXES) + "))+)$"
ORACLE["org_normalize"] = rf"""
WITH v AS (SELECT c_custkey, CAST(i - 1 AS INTEGER) AS variant, c_name || ([' Inc', ' LLC', ' & Co', ''][i]) AS org
           FROM customer, range(1, 5) t(i))
SELECT c_custkey, variant, org, nullif(regexp_replace(
      trim(regexp_replace(regexp_replace(trim(lower(org)), '[&+]+', ' and ', 'g'), '[^\w]+', ' ', 'g')),
      '{_SUF}', '\1'), '') AS canonical_org FROM v"""

_FIELD_TYPES = """ft AS (
  SELECT 'ip_str' AS field, 'string' AS value_type, count(*) AS records FROM rec
  UNION ALL SELECT 'port', 'int', count(*) FILTER (WHERE has_port) FROM rec
  UNION ALL SELECT 'timestamp', 'string', count(*) FROM rec
  UNION ALL SELECT 'hostnames', 'array', count(*) FROM rec
  UNION ALL SELECT 'domains', 'array', count(*) FROM rec
  UNION ALL SELECT 'org', 'string', count(*) FROM rec
  UNION ALL SELECT 'location', 'object', count(*) FROM rec
  UNION ALL SELECT 'cloud', 'object', count(*) FILTER (WHERE cloud_present) FROM rec
  UNION ALL SELECT 'vulns', 'object', count(*) FROM rec
  UNION ALL SELECT 'tags', 'array', count(*) FROM rec)"""
_IMPORTANT = ", ".join(f"('{f}')" for f in _K.IMPORTANT_FIELDS)
ORACLE["field_presence"] = with_ctes(ADAPTER, ORGS, _REC, _FIELD_TYPES) + f"""
, f(field) AS (VALUES {_IMPORTANT}), n AS (SELECT count(*) AS total FROM rec)
SELECT f.field, coalesce(ft.records, 0) AS present, n.total - coalesce(ft.records, 0) AS missing
FROM f CROSS JOIN n LEFT JOIN (SELECT * FROM ft WHERE records > 0) ft ON ft.field = f.field"""
ORACLE["field_types"] = with_ctes(ADAPTER, ORGS, _REC, _FIELD_TYPES) + "SELECT * FROM ft WHERE records > 0"
ORACLE["schema_discovery"] = with_ctes(ADAPTER, ORGS, _REC, _FIELD_TYPES) + """
SELECT field AS key, value_type, records FROM ft WHERE records > 0
UNION ALL SELECT t AS key, 'object', count(*) FROM (SELECT unnest(detected_technologies) AS t FROM rec) GROUP BY t
UNION ALL SELECT 'telnet', 'null', count(*) FROM rec WHERE event_id % 7 = 0 HAVING count(*) > 0"""

ORACLE["value_top"] = with_ctes(ADAPTER, ORGS, _REC) + """
, vals AS (
  SELECT 'ip_str' AS field, '"' || ip_str || '"' AS value FROM rec
  UNION ALL SELECT 'port', CAST(port AS VARCHAR) FROM rec WHERE has_port
  UNION ALL SELECT 'org', '"' || org || '"' FROM rec
  UNION ALL SELECT 'tags', CASE WHEN has_eol_tag THEN '["eol-product"]' ELSE '[]' END FROM rec
  UNION ALL SELECT 'location', '{"country_code":"' || country_code || '"}' FROM rec
  UNION ALL SELECT 'timestamp', '"' || timestamp || '"' FROM rec
  UNION ALL SELECT 'hostnames', '["' || hostname || '"]' FROM rec),
c AS (SELECT field, value, count(*) AS records FROM vals GROUP BY field, value)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY field ORDER BY records DESC, value) AS INTEGER) AS rank FROM c)
WHERE rank <= 10"""

_PSUF2 = "^(.+?)(( (" + "|".join(s for s in _K.PROFILE_LEGAL_SUFFIXES if " " in s) + "))+)$"
_PSUF1 = "^(.+?)(( (" + "|".join(s for s in _K.PROFILE_LEGAL_SUFFIXES if " " not in s) + "))+)$"
_ALIASES = rf"""al AS (
  SELECT '"' || org || '"' AS alias, nullif(regexp_replace(regexp_replace(
      trim(regexp_replace(regexp_replace(trim(lower(org)), '[&+]+', ' and ', 'g'), '[^\w]+', ' ', 'g')),
      '{_PSUF2}', '\1'), '{_PSUF1}', '\1'), '') AS canonical FROM rec),
alias_counts AS (SELECT canonical, alias, count(*) AS records FROM al GROUP BY canonical, alias),
per_c AS (SELECT canonical, CAST(sum(records) AS BIGINT) AS records, count(*) AS aliases FROM alias_counts
          WHERE canonical IS NOT NULL GROUP BY canonical)"""
ORACLE["org_canonicalization"] = with_ctes(ADAPTER, ORGS, _REC, _ALIASES) + """
SELECT (SELECT count(DISTINCT alias) FROM alias_counts) AS raw_unique, count(*) AS canonical_unique,
       CAST(coalesce(sum(CASE WHEN aliases > 1 THEN records END), 0) AS BIGINT) AS merged_records FROM per_c"""
ORACLE["org_alias_report"] = with_ctes(ADAPTER, ORGS, _REC, _ALIASES) + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY records DESC, canonical) AS INTEGER) AS rank FROM per_c)
WHERE rank <= 10"""


def _top_sql(select: str, name: str, k: int) -> str:
    return f"""
, c AS (SELECT {name}, count(*) AS records FROM ({select}) WHERE {name} IS NOT NULL AND {name} <> '' GROUP BY {name})
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY records DESC, {name}) AS INTEGER) AS rank FROM c) WHERE rank <= {k}"""


ORACLE["port_top"] = with_ctes(ADAPTER, ORGS, _REC) + _top_sql("SELECT CAST(port AS VARCHAR) AS port FROM rec", "port", 100)
ORACLE["org_top"] = with_ctes(ADAPTER, ORGS, _REC) + _top_sql("SELECT org FROM rec", "org", 100)
ORACLE["tag_top"] = with_ctes(ADAPTER, ORGS, _REC) + _top_sql(
    "SELECT 'eol-product' AS tag FROM rec WHERE has_eol_tag", "tag", 100)
ORACLE["domain_top"] = with_ctes(ADAPTER, ORGS, _REC) + _top_sql(
    "SELECT 'www.' || lower(d) AS domain FROM (SELECT unnest(registrable_domains) AS d FROM rec)", "domain", 30)
ORACLE["list_lengths"] = with_ctes(ADAPTER, ORGS, _REC) + """
SELECT 'domains' AS list, CAST(n_domains AS INTEGER) AS length, count(*) AS records FROM rec GROUP BY n_domains
UNION ALL SELECT 'hostnames', 1, count(*) FROM rec"""
ORACLE["identity_profile"] = with_ctes(ADAPTER, ORGS, _REC) + """
SELECT count(*) FILTER (WHERE n_domains > 0) AS records_with_domains,
       count(*) FILTER (WHERE n_domains = 0) AS records_without_domains,
       count(*) AS records_with_hostnames,
       round(count(*) FILTER (WHERE n_domains > 0) / count(*), 6) AS estimated_domain_coverage,
       CAST(0 AS BIGINT) AS cloud_ptr_pattern_records, CAST(0 AS BIGINT) AS exact_googleusercontent_domain_records
FROM rec"""
_CANDS = "[" + ", ".join(f"'{c}'" for c in sorted(set(_K.TECH_DETECTOR_CANDIDATES))) + "]"
ORACLE["technology_presence"] = with_ctes(ADAPTER, ORGS, _REC) + f"""
SELECT t AS technology, count(*) AS records FROM (SELECT unnest(detected_technologies) AS t FROM rec)
WHERE list_contains({_CANDS}, t) GROUP BY t"""
ORACLE["tech_cooccurrence"] = with_ctes(ADAPTER, ORGS, _REC) + f"""
, det AS (SELECT list_sort(list_filter(detected_technologies, lambda t: list_contains({_CANDS}, t))) AS d FROM rec),
pairs AS (SELECT d[i] || '+' || d[j] AS pair FROM det, range(1, 200) a(i), range(1, 200) b(j)
          WHERE i < j AND j <= len(d)),
c AS (SELECT pair, count(*) AS records FROM pairs GROUP BY pair)
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY records DESC, pair) AS INTEGER) AS rank FROM c) WHERE rank <= 50"""
ORACLE["vuln_profile"] = with_ctes(ADAPTER, ORGS, _REC) + """
SELECT CAST(sum(vuln_count) AS BIGINT) AS cve_details_seen, CAST(sum(vuln_count) AS BIGINT) AS object_details,
       CAST(sum(vuln_count) AS BIGINT) AS records_with_cvss, CAST(0 AS BIGINT) AS records_with_exploit_or_kev_flag,
       count(*) FILTER (WHERE vuln_count > 0) AS records_with_vulns FROM rec"""
ORACLE["vuln_detail_keys"] = with_ctes(ADAPTER, ORGS, _REC) + """
SELECT * FROM (SELECT 'cvss' AS key, CAST(sum(vuln_count) AS BIGINT) AS records, 1 AS rank FROM rec)
WHERE records > 0"""
ORACLE["nested_structure"] = with_ctes(ADAPTER, ORGS, _REC) + """
, cves AS (SELECT 'CVE-2024-' || event_id || '-' || i AS key FROM rec, range(0, 3) t(i) WHERE i < vuln_count)
SELECT 'vulns' AS field, '<type:object>' AS key, count(*) AS records FROM rec
UNION ALL SELECT f, '<present>', count(*) FROM rec, (VALUES ('vulns'), ('tags'), ('location')) p(f) GROUP BY f
UNION ALL SELECT 'cloud', '<present>', count(*) FROM rec WHERE cloud_present HAVING count(*) > 0
UNION ALL SELECT 'tags', '<type:array>', count(*) FROM rec
UNION ALL SELECT 'location', '<type:object>', count(*) FROM rec
UNION ALL SELECT 'cloud', '<type:object>', count(*) FROM rec WHERE cloud_present HAVING count(*) > 0
UNION ALL SELECT 'location', 'country_code', count(*) FROM rec
UNION ALL SELECT 'cloud', 'provider', count(*) FROM rec WHERE cloud_present HAVING count(*) > 0
UNION ALL SELECT 'vulns', key, 1 FROM (SELECT key FROM cves ORDER BY key LIMIT 50)"""
ORACLE["quality_check"] = with_ctes(ADAPTER) + """
SELECT count(*) AS row_count, CAST([] AS VARCHAR[]) AS missing_required_columns, count(*) > 0 AS valid FROM obs"""

# ------------------------------------------------------------------ evidence, prompts, payloads, shortlists
_SB_HEAD, _SB_TAIL = ORACLE["search_batch"].split("\nSELECT question_id, CAST(rn AS INTEGER)")
_SB = _SB_HEAD + """,
sb AS (SELECT question_id, CAST(rn AS INTEGER) AS search_rank, domain, score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, domain) AS rn FROM pool) WHERE rn <= 80),
fb AS (SELECT question_id, list(domain ORDER BY search_rank) AS fallback FROM sb WHERE search_rank <= 15 GROUP BY question_id),
resp AS (SELECT conv_id * 100000 + turn AS response_id, conv_id * 100000 + turn - 1 AS question_id, text
         FROM conversations WHERE role = 'assistant'),
rf AS (SELECT r.response_id, r.text, coalesce(fb.fallback, CAST([] AS VARCHAR[])) AS fallback
       FROM resp r LEFT JOIN fb ON fb.question_id = r.question_id)
"""
_SB += r""",
ans AS (SELECT response_id, fallback, text || CASE response_id // 100000 % 3
    WHEN 0 THEN chr(10) || to_json({'explanation': 'picked', 'domains': [fallback[2], 'unknown.example.net', fallback[1]]})::VARCHAR || chr(10)
    WHEN 1 THEN chr(10) || '{"domains": [}' ELSE '' END AS text FROM rf),
blk AS (SELECT *, regexp_extract(text, '(?s)\{.*\}') AS b, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM ans),
ok AS (SELECT *, b <> '' AND json_valid(b) AS good FROM blk),
pp AS (SELECT response_id, fallback,
    CASE WHEN good THEN coalesce(nullif(json_extract_string(b, '$.explanation'), ''), stripped) ELSE stripped END AS explanation,
    CASE WHEN good AND len(list_filter(CAST(json_extract(b, '$.domains') AS VARCHAR[]), lambda x: x <> '')) > 0
      THEN list_filter(CAST(json_extract(b, '$.domains') AS VARCHAR[]), lambda x: x <> '') ELSE fallback END AS domains FROM ok)
"""
ORACLE["payload_parse"] = _SB + "SELECT response_id, explanation, domains FROM pp"
ORACLE["allowed_domains"] = _SB + """
, c AS (SELECT question_id + 1 AS response_id, list(domain) AS allowed FROM sb GROUP BY 1),
k AS (SELECT pp.response_id, fallback, list_filter(domains, lambda x: list_contains(coalesce(allowed, []), x)) AS kept
      FROM pp LEFT JOIN c USING (response_id))
SELECT response_id, CASE WHEN len(kept) > 0 THEN kept ELSE fallback END AS domains FROM k"""
ORACLE["shortlist_join"] = _SB + """
, l AS (SELECT response_id AS list_id, CASE WHEN response_id // 100000 % 3 = 1 THEN ['unknown.example.net'] ELSE domains END AS d FROM pp),
p AS (SELECT list_id, d[i] AS domain, min(i) AS i FROM l, range(1, 100) t(i) WHERE i <= len(d) GROUP BY ALL),
k AS (SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY i) - 1 AS INTEGER) AS position, domain
      FROM p WHERE domain IN (SELECT domain FROM scored))
SELECT list_id, position, domain, false AS shows_all FROM k
UNION ALL SELECT list_id, 0, NULL, true FROM l WHERE list_id NOT IN (SELECT list_id FROM k)"""

ORACLE["evidence_pack"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SIGNALS) + """
, rs AS (SELECT domain, signal_name, row_number() OVER (PARTITION BY domain ORDER BY
           CASE WHEN severity = 'critical' THEN 1 WHEN severity = 'high' THEN 2 ELSE 3 END, signal_name) AS r FROM signals),
sl AS (SELECT domain, list(signal_name ORDER BY r) AS names FROM rs WHERE r <= 20 GROUP BY domain)
SELECT s.domain, CAST(json(score_reasons) AS VARCHAR[]) AS score_reasons,
       coalesce(sl.names, CAST([] AS VARCHAR[])) AS signal_names, 3 AS constraint_count
FROM scored s LEFT JOIN sl ON sl.domain = s.domain"""

ORACLE["cache_lookup"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT domain, exposure_score >= 50 AS cached, CASE WHEN exposure_score >= 50 THEN 'audit of ' || domain END AS cached_text
FROM scored"""

ORACLE["sample_fixed"] = """
SELECT conv_id || '-' || turn AS file, text AS line FROM conversations
ORDER BY md5('42' || chr(10) || conv_id || '-' || turn || chr(10) || text), file, line LIMIT 500"""

_PACK = """, rs AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY
           CASE WHEN severity = 'critical' THEN 1 WHEN severity = 'high' THEN 2 ELSE 3 END, signal_name) AS r FROM signals),
sl AS (SELECT domain, list({'type': signal_type, 'name': signal_name, 'severity': severity, 'description': description,
                            'confidence': confidence} ORDER BY r) AS signals FROM rs WHERE r <= 20 GROUP BY domain),
ev AS (SELECT s.domain, to_json({'workflow': 'prospect_audit', 'domain': s.domain,
    'scores': {'opportunity': opportunity_score, 'exposure': exposure_score, 'vulnerability': vulnerability_score,
               'technology': technology_score, 'recency': recency_score},
    'footprint': {'unique_ips': unique_ip_count, 'unique_ports': unique_port_count, 'unique_services': unique_service_count,
                  'cloud_observations': cloud_observation_count, 'exposed_databases': exposed_database_count,
                  'exposed_remote_access': exposed_remote_access_count, 'eol_observations': eol_observation_count,
                  'vulnerability_count': vulnerability_count,
                  'critical_vulnerabilities': critical_vulnerability_observations,
                  'high_vulnerabilities': high_vulnerability_observations},
    'score_reasons': CAST(json(score_reasons) AS VARCHAR[]), 'signals': coalesce(sl.signals, []),
    'constraints': ['Do not invent company identity, industry, employee count, or contacts.',
      'Treat scores as precomputed. Do not recalculate opportunity_score.',
      'Separate observed facts from hypotheses. Label uncertainty.']})::VARCHAR AS evidence
  FROM scored s LEFT JOIN sl ON sl.domain = s.domain),
pr AS (SELECT domain, 'Write a concise technical audit for the account using the evidence.' || chr(10) || chr(10)
    || 'Use only the JSON evidence below. If a fact is missing, say it is missing.' || chr(10) || chr(10)
    || '```json' || chr(10) || evidence || chr(10) || '```' AS prompt FROM ev)"""
ORACLE["prompt_key"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SIGNALS) + _PACK + """
SELECT domain, prompt, 'audit/v2:' || sha256('gemini-2.5-flash' || chr(10) || prompt) AS cache_key FROM pr"""

# ------------------------------------------------------------------ lexical judge over documents
_JUDGE = """tox AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id),
cases AS (
  SELECT d.doc_id AS case_id, d.lang AS run_id, v.prompt_version, [d.source, 'the'] AS must_mention,
         CASE v.prompt_version WHEN 'audit/v1' THEN d.text ELSE concat_ws(' ', d.text, d.source) END AS text,
         CASE WHEN l.toxic = 1 THEN ['password', 'secret', 'and'] ELSE CAST([] AS VARCHAR[]) END AS must_not_mention
  FROM documents d LEFT JOIN tox l ON l.doc_id = d.doc_id, (VALUES ('audit/v1'), ('audit/v2')) v(prompt_version)),
j0 AS (SELECT *, list_filter(must_mention, lambda x: contains(lower(coalesce(text, '')), lower(x))) AS true_positives,
              list_filter(must_mention, lambda x: NOT contains(lower(coalesce(text, '')), lower(x))) AS false_negatives,
              list_filter(must_not_mention, lambda x: contains(lower(coalesce(text, '')), lower(x))) AS false_positives
       FROM cases),
judged AS (SELECT *,
  round(CASE WHEN len(true_positives) + len(false_positives) > 0
             THEN len(true_positives) / (len(true_positives) + len(false_positives)) ELSE 1.0 END, 4) AS precision,
  round(CASE WHEN len(true_positives) + len(false_negatives) > 0
             THEN len(true_positives) / (len(true_positives) + len(false_negatives)) ELSE 1.0 END, 4) AS recall,
  len(false_negatives) = 0 AND len(false_positives) = 0
    AND length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) > 0 AS passed
  FROM j0),
summ AS (
  SELECT run_id, prompt_version, count(*) AS cases,
    round(CASE WHEN sum(len(true_positives)) + sum(len(false_positives)) > 0 THEN
      sum(len(true_positives)) / (sum(len(true_positives)) + sum(len(false_positives))) ELSE 0.0 END, 4) AS precision,
    round(CASE WHEN sum(len(true_positives)) + sum(len(false_negatives)) > 0 THEN
      sum(len(true_positives)) / (sum(len(true_positives)) + sum(len(false_negatives))) ELSE 0.0 END, 4) AS recall,
    round(count(*) FILTER (WHERE passed) / count(*), 4) AS pass_rate,
    CAST(sum(len(true_positives)) AS BIGINT) AS true_positives,
    CAST(sum(len(false_positives)) AS BIGINT) AS false_positives,
    CAST(sum(len(false_negatives)) AS BIGINT) AS false_negatives,
    count(*) - count(*) FILTER (WHERE passed) AS failures
  FROM judged GROUP BY run_id, prompt_version)"""
ORACLE["case_loader"] = """
WITH c AS (SELECT 'doc-' || doc_id AS case_id, source AS domain, lower(coalesce(text, '')) AS t,
  contains(lower(coalesce(text, '')), lower(source)) AS a, contains(lower(coalesce(text, '')), 'the') AS b FROM documents)
SELECT case_id, domain, (CAST(a AS INT) + CAST(b AS INT)) / 2.0 AS recall,
  a AND b AND NOT contains(t, 'password') AND length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 0 AS passed FROM c"""
ORACLE["judge_cases"] = with_ctes(_JUDGE) + """
SELECT case_id, run_id, prompt_version, true_positives, false_negatives, false_positives, precision, recall, passed FROM judged"""
ORACLE["judge_summary"] = with_ctes(_JUDGE) + "SELECT * FROM summ"
ORACLE["judge_failures"] = with_ctes(_JUDGE) + "SELECT run_id, prompt_version, case_id FROM judged WHERE NOT passed"
ORACLE["judge_delta"] = with_ctes(_JUDGE) + """
, w AS (SELECT run_id, arg_max(prompt_version, (pass_rate, recall, prompt_version)) AS winner FROM summ GROUP BY run_id)
SELECT run_id, prompt_version,
  round(precision - lag(precision) OVER p, 4) AS precision_delta,
  round(recall - lag(recall) OVER p, 4) AS recall_delta,
  round(pass_rate - lag(pass_rate) OVER p, 4) AS pass_rate_delta,
  prompt_version = winner AS is_winner
FROM summ JOIN w USING (run_id) WINDOW p AS (PARTITION BY prompt_version ORDER BY run_id)"""

# ------------------------------------------------------------------ traces
_RATES = ", ".join(f"('{m}', {a}, {b})" for m, a, b in _K.RATES_PER_MILLION)
_TRACES = f"""rates(model, input_rate, output_rate) AS (VALUES {_RATES}),
t0 AS (
  SELECT event_id AS trace_id, ts AS timestamp, event_type AS workflow,
    ['gemini-2.5-flash', 'claude-3-5-haiku-20241022', 'unlisted-model'][1 + CAST(json_extract_string(props, '$.k') AS BIGINT) % 3] AS model,
    CAST(trunc(value * 100) AS BIGINT) AS input_tokens, CAST(trunc(value * 40) AS BIGINT) AS output_tokens,
    CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS latency_ms,
    CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 = 0 AS cached,
    CASE WHEN event_type = 'error' THEN 'provider error' END AS error,
    CASE WHEN event_type <> 'error' THEN props END AS response
  FROM events),
tr AS (
  SELECT t0.*, CAST(round((CAST(input_tokens AS DECIMAL(20,0)) * CAST(coalesce(r.input_rate, {_K.DEFAULT_RATE[0]}) AS DECIMAL(10,4))
                     + CAST(output_tokens AS DECIMAL(20,0)) * CAST(coalesce(r.output_rate, {_K.DEFAULT_RATE[1]}) AS DECIMAL(10,4)))
                     * CAST(0.000001 AS DECIMAL(7,6)), 6) AS DOUBLE) AS cost_usd,
    CASE WHEN t0.model LIKE 'claude%' THEN 'claude' WHEN t0.model LIKE 'gemini%' THEN 'gemini' ELSE 'unknown' END AS provider,
    workflow || CASE WHEN coalesce(length(response) > 0, false) AND error IS NULL THEN '_generated' ELSE '_failed' END AS decision
  FROM t0 LEFT JOIN rates r ON r.model = t0.model)"""
ORACLE["trace_cost"] = with_ctes(_TRACES) + """
SELECT trace_id, workflow, model, provider, input_tokens, output_tokens, cost_usd, decision FROM tr"""
ORACLE["trace_rollup"] = with_ctes(_TRACES) + """
SELECT workflow, provider, CAST(timestamp AS DATE) AS day, count(*) AS calls, sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / 1e6 AS spend_usd,
  round(avg(CAST(cached AS DOUBLE)), 4) AS cache_hit_rate, round(avg(CAST(error IS NOT NULL AS DOUBLE)), 4) AS error_rate,
  round(quantile_cont(latency_ms, 0.5), 3) AS latency_p50, round(quantile_cont(latency_ms, 0.95), 3) AS latency_p95,
  round(quantile_cont(latency_ms, 0.99), 3) AS latency_p99
FROM tr GROUP BY ALL"""
ORACLE["rolling_cost_24h"] = with_ctes(_TRACES) + """
, hourly AS (SELECT workflow, date_trunc('hour', timestamp) AS hour, sum(CAST(round(cost_usd * 1e6) AS BIGINT)) AS c, count(*) AS n FROM tr GROUP BY ALL)
SELECT workflow, hour, sum(c) OVER w / 1e6 AS cost_24h_usd, sum(n) OVER w AS calls_24h,
       sum(c) OVER w / 1e6 > 2.0 AS alert
FROM hourly WINDOW w AS (PARTITION BY workflow ORDER BY epoch(hour) / 3600 RANGE BETWEEN 23 PRECEDING AND CURRENT ROW)"""

# ------------------------------------------------------------------ workspace
_WS = """saved AS (
  SELECT lower(replace(c_name, '#', '-')) || '.example.com' AS domain,
         strftime(make_timestamp((631152000 + c_custkey) * 1000000), '%Y-%m-%d %H:%M:%S') AS saved_at,
         c_mktsegment AS owner, 'New' AS status, CAST(NULL AS VARCHAR) AS notes,
         CAST(NULL AS VARCHAR) AS next_action, CAST(NULL AS VARCHAR) AS next_action_date FROM customer),
changes AS (
  SELECT lower(replace(c.c_name, '#', '-')) || '.example.com' AS domain, o.o_orderkey AS seq,
         CASE o.o_orderstatus WHEN 'O' THEN 'insert' WHEN 'F' THEN 'update' ELSE 'delete' END AS op,
         strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS changed_at, o.o_orderpriority AS owner,
         CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'Qualified' WHEN '2' THEN 'Contacted'
              WHEN '3' THEN 'Meeting booked' WHEN '4' THEN 'Researching' WHEN '5' THEN 'Bogus' END AS status,
         'order ' || o.o_orderkey AS notes, 'follow up' AS next_action, strftime(o.o_orderdate, '%Y-%m-%d') AS next_action_date
  FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey)"""
_STATUSES = ", ".join(f"'{s}'" for s in _K.WORKSPACE_STATUSES)
ORACLE["workspace_rejects"] = with_ctes(_WS) + f"""
SELECT domain, seq, status FROM changes WHERE op = 'update' AND NOT coalesce(status IN ({_STATUSES}), false)"""
# independent formulation: replay per key with window functions over the ordered changes
ORACLE["workspace_apply"] = with_ctes(_WS) + f"""
, valid AS (SELECT * FROM changes WHERE op <> 'update' OR status IN ({_STATUSES})),
k AS (SELECT domain, max(CASE WHEN op = 'delete' THEN seq END) AS ld FROM valid GROUP BY domain),
b AS (SELECT k.domain, k.ld, s.domain IS NOT NULL AS pre,
        (SELECT min(v.seq) FROM valid v WHERE v.domain = k.domain AND v.op = 'insert' AND v.seq > coalesce(k.ld, -1)) AS fi
      FROM k LEFT JOIN saved s ON s.domain = k.domain),
b2 AS (SELECT *, CASE WHEN ld IS NULL AND pre THEN -1 ELSE fi END AS birth FROM b),
u AS (SELECT v.domain, arg_max({{'owner': v.owner, 'status': v.status, 'notes': v.notes, 'next_action': v.next_action,
                                 'next_action_date': v.next_action_date}}, v.seq) AS u
      FROM valid v JOIN b2 ON b2.domain = v.domain WHERE v.op = 'update' AND b2.birth IS NOT NULL AND v.seq > b2.birth
      GROUP BY v.domain),
res AS (
  SELECT b2.domain,
    CASE WHEN birth = -1 THEN s.saved_at ELSE (SELECT changed_at FROM valid v WHERE v.domain = b2.domain AND v.seq = b2.birth) END AS saved_at,
    CASE WHEN u.u IS NOT NULL THEN u.u.owner WHEN birth = -1 THEN s.owner END AS owner,
    CASE WHEN u.u IS NOT NULL THEN u.u.status WHEN birth = -1 THEN s.status ELSE 'New' END AS status,
    CASE WHEN u.u IS NOT NULL THEN u.u.notes WHEN birth = -1 THEN s.notes END AS notes,
    CASE WHEN u.u IS NOT NULL THEN u.u.next_action WHEN birth = -1 THEN s.next_action END AS next_action,
    CASE WHEN u.u IS NOT NULL THEN u.u.next_action_date WHEN birth = -1 THEN s.next_action_date END AS next_action_date
  FROM b2 LEFT JOIN u ON u.domain = b2.domain LEFT JOIN saved s ON s.domain = b2.domain WHERE birth IS NOT NULL)
SELECT * FROM saved WHERE domain NOT IN (SELECT domain FROM k)
UNION ALL SELECT * FROM res"""
ORACLE["saved_join"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + r"""
, hs AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
sv AS (SELECT regexp_extract(host, '([^.]+\.example\.(com|org|net))$', 1) AS domain, CAST(min(page_id) AS VARCHAR) AS saved_at
       FROM hs GROUP BY 1)
SELECT s.domain, s.opportunity_score, sv.saved_at, 'New' AS status FROM scored s JOIN sv ON sv.domain = s.domain"""

# ------------------------------------------------------------------ small library forms
ORACLE["opportunity_library"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + """
SELECT domain, least(100.0, 0.0 + 0.3 * coalesce(icp_score, 0) + 0.2 * coalesce(exposure_score, 0)
  + 0.2 * coalesce(vulnerability_score, 0) + 0.2 * coalesce(technology_score, 0) + 0.1 * coalesce(recency_score, 0))
  AS opportunity_library_score FROM scored"""
ORACLE["ranked_accounts"] = with_ctes(ADAPTER, ACCOUNTS, SCORED) + \
    "SELECT domain, opportunity_score FROM scored ORDER BY opportunity_score DESC, domain"
_DENY = "[" + ", ".join(f"'{x}'" for x in _K.NON_TECHNOLOGY_FIELDS) + "]"
ORACLE["clean_technologies"] = with_ctes(ADAPTER, ORGS) + f"""
, keys AS (SELECT event_id AS sequence, list_sort(list_concat(
      ['ip_str', 'port', 'timestamp', 'hostnames', 'domains', 'org', 'location', 'vulns', 'tags'],
      CASE WHEN cloud_present THEN ['cloud'] ELSE CAST([] AS VARCHAR[]) END,
      detected_technologies,
      CASE WHEN event_id % 7 = 0 THEN ['telnet'] ELSE CAST([] AS VARCHAR[]) END)) AS k FROM obs_orgs)
SELECT sequence, list_filter(k, lambda x: NOT list_contains({_DENY}, x) AND NOT starts_with(x, '_')) AS technologies
FROM keys"""
# keys in code point order, whole numbers without a fraction
ORACLE["text_canonical_json"] = with_ctes(ADAPTER, ORGS) + """
, v AS (SELECT *, list_transform(range(0, vuln_count), lambda i: '"CVE-2024-' || event_id || '-' || i || '":{"cvss":' ||
      CASE WHEN i > 0 THEN '"7.5"' WHEN vuln_max_cvss = floor(vuln_max_cvss) THEN CAST(CAST(vuln_max_cvss AS BIGINT) AS VARCHAR)
           ELSE CAST(vuln_max_cvss AS VARCHAR) END || '}') AS cves FROM obs_orgs),
kv AS (SELECT event_id AS sequence, list_sort(list_concat([
    {'k': 'ip_str', 'v': to_json(ip_str)::VARCHAR}, {'k': 'port', 'v': CAST(port AS VARCHAR)},
    {'k': 'timestamp', 'v': to_json(CAST(timestamp AS VARCHAR))::VARCHAR},
    {'k': 'hostnames', 'v': to_json([hostname])::VARCHAR},
    {'k': 'domains', 'v': to_json(list_transform(registrable_domains, lambda d: 'WWW.' || d || '.'))::VARCHAR},
    {'k': 'org', 'v': to_json(org)::VARCHAR}, {'k': 'location', 'v': '{"country_code":' || to_json(country_code)::VARCHAR || '}'},
    {'k': 'vulns', 'v': '{' || array_to_string(cves, ',') || '}'},
    {'k': 'tags', 'v': CASE WHEN has_eol_tag THEN '["eol-product"]' ELSE '[]' END}],
    CASE WHEN cloud_present THEN [{'k': 'cloud', 'v': '{"provider":' || coalesce(to_json(cloud_provider)::VARCHAR, 'null') || '}'}] ELSE [] END,
    list_transform(detected_technologies, lambda t: {'k': t, 'v': '{"version":"1"}'}),
    CASE WHEN event_id % 7 = 0 THEN [{'k': 'telnet', 'v': 'null'}] ELSE [] END)) AS e FROM v)
SELECT sequence, '{' || array_to_string(list_transform(e, lambda x: '"' || x.k || '":' || x.v), ',') || '}' AS canonical_json FROM kv"""
ORACLE["account_lookup"] = with_ctes(ADAPTER, ACCOUNTS, SCORED, SIGNALS) + """
, key AS (SELECT domain FROM scored ORDER BY opportunity_score DESC, domain LIMIT 1)
SELECT s.domain, s.opportunity_score, g.signal_name, g.severity
FROM scored s JOIN key ON key.domain = s.domain LEFT JOIN signals g ON g.domain = s.domain"""
ORACLE["eval_totals"] = with_ctes(_TRACES) + """
, t1 AS (SELECT *, 'audit/v' || (1 + CAST(json_extract_string(e.props, '$.k') AS BIGINT) % 2) AS prompt_version
         FROM tr JOIN events e ON e.event_id = tr.trace_id)
SELECT prompt_version, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / 1e6 AS cost_usd, count(*) FILTER (WHERE error IS NOT NULL) AS failures
FROM t1 GROUP BY prompt_version"""

# ------------------------------------------------------------------ streaming results (checked against batch SQL)
ORACLE["stream_ingest"] = with_ctes(ADAPTER, ORGS) + \
    f"SELECT {_RC.replace('observation_id, ', '').replace('hostname,', chr(32) + 'regexp_replace(hostname, ' + chr(39) + '^www[.]' + chr(39) + ', ' + chr(39) + chr(39) + ') AS hostname,')} FROM obs_orgs"
ORACLE["ingest_observations"] = ORACLE["stream_ingest"]
ORACLE["stream_cost"] = with_ctes(_TRACES) + """
, w AS (SELECT date_trunc('hour', timestamp) - to_hours(k) AS window_start, workflow, cost_usd
        FROM tr, range(0, 24) t(k))
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, workflow,
       sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / 1e6 AS cost_usd, count(*) AS calls,
       sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / 1e6 > 2.0 AS alert
FROM w GROUP BY window_start, workflow"""
ORACLE["saved_accounts"] = ORACLE["workspace_apply"].replace(
    "SELECT * FROM saved WHERE domain NOT IN (SELECT domain FROM k)\nUNION ALL SELECT * FROM res",
    ", allrows AS (SELECT * FROM saved WHERE domain NOT IN (SELECT domain FROM k) UNION ALL SELECT * FROM res)\n"
    "SELECT domain, saved_at, status FROM allrows ORDER BY saved_at DESC, domain")
ORACLE["read_accounts"] = ORACLE["accounts_mart"]
ORACLE["read_account_signals"] = with_ctes(ADAPTER, ACCOUNTS, SIGNALS) + """
SELECT * FROM signals WHERE domain = (SELECT min(domain) FROM accounts)"""
ORACLE["read_search"] = ORACLE["search_keyword"]
ORACLE["cost_model"] = with_ctes(_TRACES) + """
SELECT workflow, model, count(*) AS calls, round(avg(input_tokens), 2) AS avg_input_tokens,
       round(avg(output_tokens), 2) AS avg_output_tokens,
       round(sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / count(*) / 1e6, 8) AS cost_per_call_usd,
       sum(CAST(round(cost_usd * 1e6) AS BIGINT)) / 1e6 AS total_cost_usd
FROM tr GROUP BY workflow, model"""

# ------------------------------------------------------------------ records with every field and odd shapes
from scanmart.plans.rich import ORACLE as _RICH_ORACLE  # noqa: E402

ORACLE |= _RICH_ORACLE
ORACLE["alias_lists"] = with_ctes(ADAPTER, ORGS, _REC, _ALIASES) + """
, top AS (SELECT canonical FROM per_c ORDER BY records DESC, canonical LIMIT 10)
SELECT canonical, alias, records, CAST(row_number() OVER (PARTITION BY canonical ORDER BY records DESC, alias) AS INTEGER) AS rank
FROM alias_counts WHERE canonical IN (SELECT canonical FROM top)"""
ORACLE["first_samples"] = "SELECT sequence, canonical_json AS record FROM (" + ORACLE["text_canonical_json"] + \
    ") ORDER BY sequence LIMIT 3"

# ------------------------------------------------------------------ SQL kept beside its queries
from scanmart.plans import incremental, report_queries, sketch_queries, suffix_cases  # noqa: E402

ORACLE["search_batch_many"] = ORACLE["search_batch"].replace(with_ctes(ADAPTER, ACCOUNTS, SCORED), with_ctes(ADAPTER, _MANY, _MANY_ACCOUNTS, SCORED))
ORACLE |= suffix_cases.ORACLE | incremental.sql(ORACLE) | sketch_queries.sql(ORACLE) | report_queries.sql(ORACLE)
