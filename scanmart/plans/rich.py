"""Raw records with every field and every odd shape, one per event: Spark text and the same in DuckDB SQL.

Each part is an SQL expression over the event id ``e`` that both engines can run (integer
arithmetic, CASE and ||), so the text of the records is the same; what the operators make of
it is stated separately in :data:`ROWS`, column by column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanmart.functions import constants as K
from scanmart.plans.oracle import with_ctes

#: Key -> JSON text (null: the key is absent).
PARTS = {
    "asn": """CASE e % 3 WHEN 0 THEN '"AS' || (e % 11) || '"' WHEN 1 THEN '64500' END""",
    "cloud": """CASE e % 5 WHEN 0 THEN '{"provider":"P' || (e % 2) || '","region":"r","service":"s"}' WHEN 1 THEN '{}' END""",
    "cpe": """CASE WHEN e % 2 = 0 THEN '["cpe:/a:' || (e % 3) || '"]' END""",
    "cpe23": """CASE e % 4 WHEN 0 THEN '["a","b"]' WHEN 1 THEN '[]' END""",
    "domains": """CASE e % 5 WHEN 0 THEN '["googleusercontent.com"]' WHEN 1 THEN '[]' WHEN 2 THEN
        '["A' || (e % 7) || '.Example.com.\\t","b.example.org",null]' WHEN 3 THEN '["c' || (e % 9) || '.example.net"]' END""",
    "hostnames": """CASE e % 4 WHEN 0 THEN '["ec2-' || (e % 3) || '.amazonaws.com","x.example.com"]' WHEN 1 THEN
        '["vm.cloudapp.azure.com."]' WHEN 2 THEN '[]' END""",
    "http": """CASE WHEN e % 3 = 0 THEN '{"host":"h","html":' || CASE WHEN e % 2 = 0 THEN '"0"' ELSE '""' END ||
        CASE WHEN e % 4 = 0 THEN ',"redirects":[1,2]' ELSE '' END || ',"securitytxt":' ||
        CASE WHEN e % 5 = 0 THEN '"x"' ELSE 'null' END || ',"server":"s","status":200,"title":"t' || (e % 5) || '"}' END""",
    "ip_str": """'"198.51.100.' || (e % 250) || '"'""",
    "ipv6": """CASE WHEN e % 9 = 0 THEN '"2001:db8::' || (e % 4) || '"' END""",
    "isp": """'"isp' || (e % 3) || '"'""",
    "location": """CASE WHEN e % 8 = 7 THEN '"nowhere"' ELSE '{"city":"Y","country_code":"C' || (e % 4) ||
        '","country_name":"N' || (e % 4) || '","latitude":1.5,"longitude":' || (e % 90) || ',"region_code":' ||
        CASE WHEN e % 2 = 0 THEN '"R' || (e % 6) || '"' ELSE 'null' END || '}' END""",
    "org": """CASE WHEN e % 2 = 0 THEN '"Org ' || (e % 8) || ' GmbH & Co"' ELSE '5' END""",
    "os": """CASE WHEN e % 2 = 0 THEN '"os' || (e % 3) || '"' ELSE 'null' END""",
    "port": """CASE e % 3 WHEN 0 THEN '443' WHEN 1 THEN '"80"' ELSE '22' END""",
    "product": """CASE e % 3 WHEN 0 THEN '"prod' || (e % 6) || '"' WHEN 1 THEN '""' END""",
    "ssl": """CASE e % 7 WHEN 0 THEN '{"cert_expiry":"E","cert_subject":"","issuer":"I","subject":"CN=' || (e % 3) || '","version":"TLS"}'
        WHEN 1 THEN '"text"' END""",
    "tags": """CASE e % 4 WHEN 0 THEN '["eol-os","x"]' WHEN 1 THEN '"notalist"' WHEN 2 THEN '[1,null]' ELSE '[]' END""",
    "timestamp": """'"2025-01-01T00:00:' || (10 + e % 50) || '"'""",
    "transport": """CASE WHEN e % 2 = 0 THEN '"tcp"' ELSE '"udp"' END""",
    "version": """CASE WHEN e % 2 = 1 THEN '"1.' || (e % 4) || '"' END""",
    "vulns": """CASE e % 6 WHEN 0 THEN '{"CVE-a":{"cvss":7.1,"kev":true},"CVE-b":"text"}' WHEN 1 THEN '["x"]' WHEN 2 THEN
        '{"CVE-c":{"cvss_v2":4,"note":"KEV list"}}' WHEN 3 THEN '{}' WHEN 4 THEN '{"CVE-d":5}' END""",
    "afp": """CASE WHEN e % 5 = 0 THEN 'null' END""",
    "dns": """CASE WHEN e % 3 = 0 THEN 'true' END""",
    "elastic": """CASE WHEN e % 10 <= 3 THEN '{"v":1}' END""",
    "ftp": """CASE WHEN e % 2 = 0 THEN '{}' END""",
    "_shodan": """'{"module":"m"}'""",
}


def rich_records(events: DataFrame) -> DataFrame:
    """(sequence, value): one raw record text per event."""
    e = events.select(F.col("event_id").alias("e"))
    parts = [F.expr(f"'\"{k}\":' || {sql}".replace("\\t", "\\\\t")) for k, sql in PARTS.items()]
    return e.select(F.col("e").alias("sequence"), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("value"))


def _lst(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_NONE = "CAST([] AS VARCHAR[])"
_TEXT = lambda key: f"coalesce({PARTS[key]}, 'null')"
#: Column of the curated observation -> its value by the rules, over ``e``.
ROWS = {
    "timestamp": "'2025-01-01T00:00:' || (10 + e % 50)",
    "ip": "'198.51.100.' || (e % 250)",
    "ip_str": "'198.51.100.' || (e % 250)",
    "ipv6": "CASE WHEN e % 9 = 0 THEN '2001:db8::' || (e % 4) END",
    "asn": "CASE e % 3 WHEN 0 THEN 'AS' || (e % 11) WHEN 1 THEN '64500' END",
    "domains": f"""CASE e % 5 WHEN 0 THEN ['googleusercontent.com'] WHEN 2 THEN ['a' || (e % 7) || '.example.com', 'b.example.org']
        WHEN 3 THEN ['c' || (e % 9) || '.example.net'] ELSE {_NONE} END""",
    "hostnames": f"""CASE e % 4 WHEN 0 THEN ['ec2-' || (e % 3) || '.amazonaws.com', 'x.example.com']
        WHEN 1 THEN ['vm.cloudapp.azure.com'] ELSE {_NONE} END""",
    "registrable_domains": f"""CASE e % 5 WHEN 0 THEN ['googleusercontent.com'] WHEN 2 THEN ['a' || (e % 7) || '.example.com', 'b.example.org']
        WHEN 3 THEN ['c' || (e % 9) || '.example.net'] ELSE {_NONE} END""",
    "country_code": "CASE WHEN e % 8 <> 7 THEN 'C' || (e % 4) END",
    "country_name": "CASE WHEN e % 8 <> 7 THEN 'N' || (e % 4) END",
    "region_code": "CASE WHEN e % 8 <> 7 AND e % 2 = 0 THEN 'R' || (e % 6) END",
    "city": "CASE WHEN e % 8 <> 7 THEN 'Y' END",
    "latitude": "CASE WHEN e % 8 <> 7 THEN CAST(1.5 AS DOUBLE) END",
    "longitude": "CASE WHEN e % 8 <> 7 THEN CAST(e % 90 AS DOUBLE) END",
    "port": "CAST(CASE e % 3 WHEN 0 THEN 443 WHEN 2 THEN 22 END AS INTEGER)",
    "transport": "CASE WHEN e % 2 = 0 THEN 'tcp' ELSE 'udp' END",
    "service_category": "CASE e % 3 WHEN 0 THEN 'web' WHEN 2 THEN 'remote_access' END",
    "product": "CASE e % 3 WHEN 0 THEN 'prod' || (e % 6) WHEN 1 THEN '' END",
    "version": "CASE WHEN e % 2 = 1 THEN '1.' || (e % 4) END",
    "os": "CASE WHEN e % 2 = 0 THEN 'os' || (e % 3) END",
    "http_status": "CAST(CASE WHEN e % 3 = 0 THEN 200 END AS INTEGER)",
    "http_title": "CASE WHEN e % 3 = 0 THEN 't' || (e % 5) END",
    "http_server": "CASE WHEN e % 3 = 0 THEN 's' END",
    "http_host": "CASE WHEN e % 3 = 0 THEN 'h' END",
    "http_redirect_count": "CAST(CASE WHEN e % 12 = 0 THEN 2 ELSE 0 END AS INTEGER)",
    "http_securitytxt": "e % 15 = 0",
    "http_has_html": "e % 6 = 0",
    "ssl_present": "e % 7 <= 1",
    "ssl_version": "CASE WHEN e % 7 = 0 THEN 'TLS' END",
    "ssl_cert_subject": "CASE WHEN e % 7 = 0 THEN 'CN=' || (e % 3) END",
    "ssl_cert_issuer": "CASE WHEN e % 7 = 0 THEN 'I' END",
    "ssl_cert_expiry": "CASE WHEN e % 7 = 0 THEN 'E' END",
    "cloud_present": "e % 5 = 0",
    "cloud_provider": "CASE WHEN e % 5 = 0 THEN 'P' || (e % 2) END",
    "cloud_region": "CASE WHEN e % 5 = 0 THEN 'r' END",
    "cloud_service": "CASE WHEN e % 5 = 0 THEN 's' END",
    "org": "CASE WHEN e % 2 = 0 THEN 'Org ' || (e % 8) || ' GmbH & Co' END",
    "canonical_org": "CASE WHEN e % 2 = 0 THEN 'org ' || (e % 8) || ' gmbh and' END",
    "isp": "'isp' || (e % 3)",
    "tags": f"CASE e % 4 WHEN 0 THEN ['eol-os', 'x'] WHEN 2 THEN ['1', 'None'] ELSE {_NONE} END",
    "tag_count": "CAST(CASE WHEN e % 2 = 0 THEN 2 ELSE 0 END AS INTEGER)",
    "has_eol_tag": "e % 4 = 0",
    "cpe": f"CASE WHEN e % 2 = 0 THEN ['cpe:/a:' || (e % 3)] ELSE {_NONE} END",
    "cpe23": f"CASE WHEN e % 4 = 0 THEN ['a', 'b'] ELSE {_NONE} END",
    "cpe_count": "CAST(CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END AS INTEGER)",
    "cpe23_count": "CAST(CASE WHEN e % 4 = 0 THEN 2 ELSE 0 END AS INTEGER)",
    "vuln_present": "e % 6 IN (0, 2, 4)",
    "vuln_count": "CAST(CASE e % 6 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS INTEGER)",
    "vuln_ids": f"CASE e % 6 WHEN 0 THEN ['CVE-a', 'CVE-b'] WHEN 2 THEN ['CVE-c'] WHEN 4 THEN ['CVE-d'] ELSE {_NONE} END",
    "vuln_max_cvss": "CAST(CASE e % 6 WHEN 0 THEN 7.1 WHEN 2 THEN 4 END AS DOUBLE)",
    "vuln_has_known_exploit": "e % 6 = 0",
    "detected_technologies": """list_filter([CASE WHEN e % 3 = 0 THEN 'dns' END, CASE WHEN e % 10 <= 3 THEN 'elastic' END,
        CASE WHEN e % 2 = 0 THEN 'ftp' END], lambda x: x IS NOT NULL)""",
    "detected_services": """list_filter([CASE WHEN e % 3 = 0 THEN 'dns' END, CASE WHEN e % 2 = 0 THEN 'ftp' END], lambda x: x IS NOT NULL)""",
    "service_count": "CAST((CASE WHEN e % 3 = 0 THEN 1 ELSE 0 END) + (CASE WHEN e % 2 = 0 THEN 1 ELSE 0 END) AS INTEGER)",
    "sensitive_service_count": "CAST(0 AS INTEGER)",
    "remote_access_service_count": "CAST(0 AS INTEGER)",
    "database_service_count": "CAST(0 AS INTEGER)",
    "raw_tags_json": _TEXT("tags"),
    "raw_vulns_json": _TEXT("vulns"),
    "raw_http_json": _TEXT("http"),
    "raw_ssl_json": _TEXT("ssl"),
}
_COLUMNS = ", ".join(f"{sql} AS {name}" for name, sql in ROWS.items())
_RICH = f"""ev AS (SELECT event_id AS e FROM events),
rich AS (SELECT e, {_COLUMNS}, {PARTS["domains"]} AS domains_json, {PARTS["hostnames"]} AS hostnames_json,
  coalesce(json_array_length({PARTS["domains"]}), 0) AS n_domains, coalesce(json_array_length({PARTS["hostnames"]}), 0) AS n_hostnames FROM ev)"""

_PORT_TEXT = "CASE e % 3 WHEN 0 THEN '443' WHEN 1 THEN '80' ELSE '22' END"
_TECHS = """list_filter([CASE WHEN e % 3 = 0 THEN 'dns' END, CASE WHEN e % 10 <= 3 THEN 'elastic' END,
  CASE WHEN e % 2 = 0 THEN 'ftp' END], lambda x: x IS NOT NULL)"""


def _ranked(inner: str, key: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY records DESC, {key}) AS INTEGER) AS rank FROM ({inner}))
WHERE rank <= {k}"""


ORACLE = {
    "rich_observations": with_ctes(_RICH) + f"""
SELECT sha1(concat_ws(':', CAST(e AS VARCHAR), ip_str, timestamp, {_PORT_TEXT})) AS observation_id, domains[1] AS domain,
  hostnames[1] AS hostname, {", ".join(ROWS)} FROM rich""",
    "rich_identity": with_ctes(_RICH) + """
SELECT count(*) FILTER (WHERE n_domains > 0) AS records_with_domains, count(*) FILTER (WHERE n_domains = 0) AS records_without_domains,
  count(*) FILTER (WHERE n_hostnames > 0) AS records_with_hostnames,
  round(count(*) FILTER (WHERE n_domains > 0) / count(*), 6) AS estimated_domain_coverage,
  count(*) FILTER (WHERE e % 5 = 0 OR e % 4 IN (0, 1)) AS cloud_ptr_pattern_records,
  count(*) FILTER (WHERE e % 5 = 0) AS exact_googleusercontent_domain_records FROM rich""",
    "list_maxima": with_ctes(_RICH) + """
SELECT CAST(max(n_domains) AS INTEGER) AS max_domains, CAST(max(n_hostnames) AS INTEGER) AS max_hostnames FROM rich""",
    "rich_lengths": with_ctes(_RICH) + """
SELECT 'domains' AS list, CAST(n_domains AS INTEGER) AS length, count(*) AS records FROM rich GROUP BY n_domains
UNION ALL SELECT 'hostnames', CAST(n_hostnames AS INTEGER), count(*) FROM rich GROUP BY n_hostnames""",
    "rich_pairs": with_ctes(_RICH) + _ranked("""
  SELECT pair, count(*) AS records FROM (
    SELECT 'dns+elastic' AS pair FROM rich WHERE e % 3 = 0 AND e % 10 <= 3
    UNION ALL SELECT 'dns+ftp' FROM rich WHERE e % 6 = 0
    UNION ALL SELECT 'elastic+ftp' FROM rich WHERE e % 10 <= 3 AND e % 2 = 0) GROUP BY pair""", "pair", 50),
    "technologies_above": with_ctes(_RICH) + f"""
SELECT technology, count(*) AS records, CAST({len(K.TECH_DETECTOR_CANDIDATES)} AS INTEGER) AS candidate_count
FROM (SELECT unnest({_TECHS}) AS technology FROM rich) GROUP BY technology HAVING count(*) > 100""",
    "technology_examples": with_ctes(_RICH) + f"""
SELECT e AS sequence, {_TECHS} AS technologies FROM rich WHERE len({_TECHS}) > 1 ORDER BY e LIMIT 20""",
    "vuln_value_types": with_ctes(_RICH) + """
SELECT value_type, count(*) AS records FROM (
  SELECT unnest(CASE e % 6 WHEN 0 THEN ['object', 'string'] WHEN 1 THEN ['array'] WHEN 2 THEN ['object'] WHEN 4 THEN ['int'] END) AS value_type
  FROM rich) GROUP BY value_type""",
    "rich_vulns": with_ctes(_RICH) + """
SELECT count(*) FILTER (WHERE e % 6 IN (0, 1, 2, 4)) AS records_with_vulns,
  CAST(sum(CASE e % 6 WHEN 0 THEN 2 WHEN 2 THEN 1 WHEN 4 THEN 1 ELSE 0 END) AS BIGINT) AS cve_details_seen,
  count(*) FILTER (WHERE e % 6 IN (0, 2)) AS object_details, count(*) FILTER (WHERE e % 6 IN (0, 2)) AS records_with_cvss,
  count(*) FILTER (WHERE e % 6 IN (0, 2)) AS records_with_exploit_or_kev_flag FROM rich""",
    "product_top": with_ctes(_RICH) + _ranked(
        "SELECT product, count(*) AS records FROM rich WHERE product <> '' GROUP BY product", "product", 100),
    "rich_nested": with_ctes(_RICH) + """
, keys AS (
  SELECT unnest(CASE WHEN e % 3 = 0 THEN ['host', 'html', 'securitytxt', 'server', 'status', 'title'] END) AS key, 'http' AS field FROM rich
  UNION ALL SELECT 'redirects', 'http' FROM rich WHERE e % 12 = 0
  UNION ALL SELECT unnest(['cert_expiry', 'cert_subject', 'issuer', 'subject', 'version']), 'ssl' FROM rich WHERE e % 7 = 0
  UNION ALL SELECT unnest(['provider', 'region', 'service']), 'cloud' FROM rich WHERE e % 5 = 0
  UNION ALL SELECT unnest(['city', 'country_code', 'country_name', 'latitude', 'longitude', 'region_code']), 'location' FROM rich WHERE e % 8 <> 7
  UNION ALL SELECT 'module', '_shodan' FROM rich
  UNION ALL SELECT unnest(vuln_ids), 'vulns' FROM rich),
types AS (
  SELECT 'http' AS field, 'object' AS t FROM rich WHERE e % 3 = 0
  UNION ALL SELECT 'ssl', CASE e % 7 WHEN 0 THEN 'object' ELSE 'string' END FROM rich WHERE e % 7 <= 1
  UNION ALL SELECT 'cloud', 'object' FROM rich WHERE e % 5 <= 1
  UNION ALL SELECT 'cpe23', 'array' FROM rich WHERE e % 4 <= 1
  UNION ALL SELECT 'tags', CASE e % 4 WHEN 1 THEN 'string' ELSE 'array' END FROM rich
  UNION ALL SELECT 'location', CASE e % 8 WHEN 7 THEN 'string' ELSE 'object' END FROM rich
  UNION ALL SELECT '_shodan', 'object' FROM rich
  UNION ALL SELECT 'vulns', CASE e % 6 WHEN 1 THEN 'array' ELSE 'object' END FROM rich WHERE e % 6 <> 5)
SELECT field, key, count(*) AS records FROM keys GROUP BY ALL
UNION ALL SELECT field, '<type:' || t || '>', count(*) FROM types GROUP BY ALL
UNION ALL SELECT field, '<present>', count(*) FROM types GROUP BY ALL""",
}
