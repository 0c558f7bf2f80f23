"""Independent DuckDB SQL for every registered query (the correctness oracle).

The shared CTE ``ADAPTER`` is the table adapter of FIXTURES.md section 2 plus the
derived service columns; every mart query builds on it.
"""

from __future__ import annotations

from scanmart.functions import constants as K


def _lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_SERVICE_CASE = "CASE port " + " ".join(f"WHEN {p} THEN '{c}'" for p, c in K.SERVICE_CATEGORIES.items()) + " END"
_ORG_SUFFIX_RE = "^(.+?)(( (" + "|".join(K.ORG_LEGAL_SUFFIXES) + "))+)$"

ADAPTER = rf"""
np AS (SELECT count(*) AS n FROM pages),
h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages),
e AS (SELECT event_id, ts, user_id, event_type, value,
             CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
             event_id % n AS p1, (event_id + 1) % n AS p2 FROM events, np),
obs0 AS (
  SELECT event_id, user_id, k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
    '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS ip_str, a.host AS hostname,
    list_sort(list_distinct(list_transform(
       CASE WHEN event_id % 10 = 0 THEN [a.host, b.host] ELSE [a.host] END,
       lambda x: regexp_extract(x, '([^.]+\.example\.(com|org|net))$', 1)))) AS registrable_domains,
    CAST([443,80,22,3306,5432,6379,3389,21,25,53,9200,23,8080,554][1 + k % (1 + p1 % 14)] AS INTEGER) AS port,
    n.n_name AS country_code, CAST(NULL AS VARCHAR) AS region_code, event_type = 'view' AS cloud_present,
    CASE WHEN event_type = 'view' AND k % 2 = 0 THEN 'AWS' END AS cloud_provider,
    CAST(CASE WHEN event_type = 'error' AND p1 % 3 = 0 THEN 1 + k % 3 ELSE 0 END AS INTEGER) AS vuln_count,
    CAST(CASE WHEN event_type = 'error' AND p1 % 3 = 0 THEN least(10.0, round(value / 15, 1)) END AS DOUBLE) AS vuln_max_cvss,
    (event_type = 'signup' AND p1 % 5 = 0) AS has_eol_tag,
    CASE WHEN event_type = 'click' AND p1 % 4 = 0 THEN [['ssh','redis','mysql','ftp'][1 + k % 4]]
         WHEN event_type = 'click' THEN ['nginx_status'] ELSE CAST([] AS VARCHAR[]) END AS detected_technologies
  FROM e JOIN h a ON a.page_id = e.p1 JOIN h b ON b.page_id = e.p2
  JOIN nation n ON n.n_nationkey = e.user_id % 25),
obs1 AS (
  SELECT *, {_SERVICE_CASE} AS service_category,
    list_sort(list_intersect(detected_technologies, {_lst(K.SERVICE_DETECTORS)})) AS detected_services
  FROM obs0),
obs AS (
  SELECT *,
    CAST(len(detected_services) AS INTEGER) AS service_count,
    CAST(len(list_intersect(detected_services, {_lst(K.DATABASE_SERVICES + K.REMOTE_ACCESS_SERVICES)})) AS INTEGER) AS sensitive_service_count,
    CAST(len(list_intersect(detected_services, {_lst(K.REMOTE_ACCESS_SERVICES)})) AS INTEGER) AS remote_access_service_count,
    CAST(len(list_intersect(detected_services, {_lst(K.DATABASE_SERVICES)})) AS INTEGER) AS database_service_count,
    sha1(concat_ws(':', CAST(event_id AS VARCHAR), ip_str, timestamp, coalesce(CAST(port AS VARCHAR), 'None'))) AS observation_id
  FROM obs1)
"""

ORGS = rf"""
obs_org AS (
  SELECT o.*, c.c_name || ([' Inc', ' LLC', ' & Co', ''][1 + o.k % 4]) AS org
  FROM obs o JOIN customer c ON c.c_custkey = o.user_id),
obs_orgs AS (
  SELECT *, nullif(regexp_replace(
      trim(regexp_replace(regexp_replace(trim(lower(org)), '[&+]+', ' and ', 'g'), '[^\w]+', ' ', 'g')),
      '{_ORG_SUFFIX_RE}', '\1'), '') AS canonical_org
  FROM obs_org)
"""

ACCOUNTS = r"""
ao AS (SELECT unnest(registrable_domains) AS domain, * FROM obs
       WHERE registrable_domains IS NOT NULL AND len(registrable_domains) > 0),
accounts AS (
  SELECT domain AS account_id, domain,
    min(try_cast(timestamp AS TIMESTAMP)) AS first_seen,
    max(try_cast(timestamp AS TIMESTAMP)) AS last_seen,
    count(*) AS observation_count,
    count(DISTINCT ip_str) AS unique_ip_count,
    count(DISTINCT hostname) AS unique_hostname_count,
    count(DISTINCT port) AS unique_port_count,
    count(DISTINCT service_category) AS unique_service_count,
    count(*) FILTER (WHERE cloud_present) AS cloud_observation_count,
    count(*) FILTER (WHERE cloud_present AND cloud_provider IS NOT NULL) AS identified_cloud_observation_count,
    list_sort(list(DISTINCT country_code) FILTER (WHERE country_code IS NOT NULL)) AS countries,
    list_sort(list(DISTINCT region_code) FILTER (WHERE region_code IS NOT NULL)) AS regions,
    list_sort(list(DISTINCT cloud_provider) FILTER (WHERE cloud_provider IS NOT NULL)) AS cloud_providers,
    list_sort(list_distinct(flatten(list(detected_technologies)))) AS technologies,
    list_sort(list_distinct(flatten(list(detected_services)))) AS services,
    CAST(sum(vuln_count) AS BIGINT) AS vulnerability_count,
    CAST(sum(CASE WHEN vuln_max_cvss >= 9.0 THEN 1 ELSE 0 END) AS BIGINT) AS critical_vulnerability_observations,
    CAST(sum(CASE WHEN vuln_max_cvss >= 7.0 AND vuln_max_cvss < 9.0 THEN 1 ELSE 0 END) AS BIGINT) AS high_vulnerability_observations,
    CAST(sum(CASE WHEN has_eol_tag THEN 1 ELSE 0 END) AS BIGINT) AS eol_observation_count,
    CAST(sum(database_service_count) AS BIGINT) AS exposed_database_count,
    CAST(sum(remote_access_service_count) AS BIGINT) AS exposed_remote_access_count
  FROM ao GROUP BY domain)
"""


def _ls(col: str, mid: float) -> str:
    v = f"CAST(coalesce({col}, 0) AS DOUBLE)"
    return (f"(CASE WHEN {v} <= 0 THEN 0.0 ELSE "
            f"round(greatest(0.0, least(100.0, 100.0 * ln(1.0 + {v}) / ln({1.0 + mid!r}))), 2) END)")


def _bounded(x: str) -> str:
    return f"round(greatest(0.0, least(100.0, {x})), 2)"


_ICP = _bounded("""40.0
      + CASE WHEN coalesce(unique_ip_count,0) BETWEEN 3 AND 200 THEN 20.0 WHEN coalesce(unique_ip_count,0) > 200 THEN 8.0 ELSE 0.0 END
      + CASE WHEN coalesce(unique_service_count,0) >= 3 THEN 15.0 ELSE 0.0 END
      + CASE WHEN len(list_filter(coalesce(technologies, []), lambda t: NOT starts_with(t, '_'))) >= 2 THEN 15.0 ELSE 0.0 END
      + CASE WHEN coalesce(len(countries) > 0, false) THEN 10.0 ELSE 0.0 END
      - CASE WHEN coalesce(cloud_observation_count,0) <> 0 AND coalesce(unique_ip_count,0) >= 10
                  AND coalesce(unique_service_count,0) <= 2
                  AND len(list_filter(coalesce(technologies, []), lambda t: NOT starts_with(t, '_'))) <= 1
             THEN 15.0 ELSE 0.0 END""")

SCORED = rf"""
ref AS (SELECT coalesce(max(last_seen), CAST(now() AS TIMESTAMP)) AS reference_time FROM accounts),
comp AS (
  SELECT a.*,
    {_ICP} AS icp_score,
    {_bounded(f"60.0 * {_ls('unique_port_count', 10)} / 100.0 + 20.0 * {_ls('exposed_database_count', 3)} / 100.0 + 20.0 * {_ls('exposed_remote_access_count', 3)} / 100.0")} AS exposure_score,
    {_bounded(f"55.0 * {_ls('critical_vulnerability_observations', 1)} / 100.0 + 30.0 * {_ls('high_vulnerability_observations', 3)} / 100.0 + 15.0 * {_ls('vulnerability_count', 10)} / 100.0")} AS vulnerability_score,
    {_bounded(f"70.0 * {_ls('(CASE WHEN technologies IS NULL THEN 0 ELSE len(technologies) END)', 5)} / 100.0 + 30.0 * {_ls('unique_service_count', 5)} / 100.0")} AS technology_score,
    CASE WHEN last_seen IS NULL THEN 0.0 ELSE
      {_bounded("100.0 * exp(-greatest(0.0, CAST(date_diff('microsecond', last_seen, reference_time) AS DOUBLE) / 86400e6) / 30.0)")} END AS recency_score
  FROM accounts a, ref),
scored AS (
  SELECT *,
    CAST(round(CAST(0.0 + 0.3 * icp_score + 0.2 * exposure_score + 0.2 * vulnerability_score + 0.2 * technology_score + 0.1 * recency_score AS DECIMAL(20,9)), 2) AS DOUBLE) AS opportunity_score,
    to_json(list_filter([
      CASE WHEN coalesce(critical_vulnerability_observations,0) <> 0 THEN critical_vulnerability_observations || ' critical vulnerability observations' END,
      CASE WHEN coalesce(exposed_database_count,0) <> 0 THEN exposed_database_count || ' exposed database observations' END,
      CASE WHEN coalesce(exposed_remote_access_count,0) <> 0 THEN exposed_remote_access_count || ' exposed remote-access observations' END,
      CASE WHEN coalesce(eol_observation_count,0) <> 0 THEN eol_observation_count || ' EOL observations' END,
      CASE WHEN coalesce(unique_port_count,0) >= 10 THEN unique_port_count || ' unique exposed ports' END
    ], lambda t: t IS NOT NULL)) AS score_reasons
  FROM comp)
"""


def _signal_rows() -> str:
    parts = []
    for stype, sname, metric, thr, desc in K.SIGNAL_RULES:
        sev = "critical" if sname == "critical_vulnerability" else ("high" if stype in ("vulnerability", "exposure") else "medium")
        parts.append(
            f"SELECT account_id, domain, sha1(account_id || ':{sname}') AS signal_id, '{stype}' AS signal_type, "
            f"'{sname}' AS signal_name, '{sev}' AS severity, last_seen AS observed_at, CAST(NULL AS TIMESTAMP) AS first_seen, "
            f"last_seen, CAST(coalesce({metric},0) AS DOUBLE) AS value, CAST([] AS VARCHAR[]) AS evidence_observation_ids, "
            f"CAST(0.9 AS DOUBLE) AS confidence, '{desc}' AS description, observation_count, metrics_json "
            f"FROM acc_m WHERE coalesce({metric},0) >= {thr}")
    return "\nUNION ALL\n".join(parts)


SIGNALS = rf"""
acc_m AS (
  SELECT *, to_json({{'attack_surface_size': coalesce(unique_port_count,0),
                      'vulnerability_count': coalesce(vulnerability_count,0),
                      'critical_vulnerability_count': coalesce(critical_vulnerability_observations,0),
                      'high_vulnerability_count': coalesce(high_vulnerability_observations,0),
                      'eol_observation_count': coalesce(eol_observation_count,0),
                      'exposed_database_count': coalesce(exposed_database_count,0),
                      'exposed_remote_access_count': coalesce(exposed_remote_access_count,0)}}) AS metrics_json
  FROM accounts),
signals AS (
{_signal_rows()}
)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def KEYWORD_SQL(q: str, prefix: str = "") -> str:  # noqa: N802
    """Keyword-group rule: any group keyword occurs in the question and its metric > 0."""
    parts = []
    for keywords, field in K.KEYWORD_FILTERS:
        kw = " OR ".join(f"contains({q}, '{k}')" for k in keywords)
        parts.append(f"(({kw}) AND coalesce({prefix}{field}, 0) > 0)")
    return "(" + " OR ".join(parts) + ")"


def SEARCH_SQL(question: str) -> str:  # noqa: N802
    """Single-question search over ``scored`` -> CTE ``found`` (<= 80 rows)."""
    import re

    q = question.strip().casefold()
    toks = [t for t in re.split(r"[^a-z0-9.\-]+", q) if t]
    conds = [f"contains(lower(coalesce(domain, '')), '{q}')"]
    conds += [f"contains(lower(coalesce(domain, '')), '{t}')" for t in toks if "." in t]
    hay = "lower(coalesce(domain, '') || ' ' || coalesce(array_to_string(countries, ' '), ''))"
    conds += [f"contains({hay}, '{t}')" for t in toks if len(t) >= 3]
    for keywords, field in K.KEYWORD_FILTERS:
        if any(k in q for k in keywords):
            conds.append(f"coalesce({field}, 0) > 0")
    pred = " OR ".join(conds)
    return f"""hit AS (SELECT *, ({pred}) AS _m FROM scored),
found AS (SELECT * EXCLUDE (_m) FROM hit WHERE _m OR NOT (SELECT coalesce(bool_or(_m), false) FROM hit)
          ORDER BY coalesce(opportunity_score, 0) DESC, domain LIMIT 80)"""
