"""Page names under real public suffixes: the packaged suffix list against stated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmart.functions import columns as C
from scanmart.operators import observations as O
from scanmart.sources import suffixes as PSL
from scanmart.sources.tables import table

# fixed values: (ending of a host, number of last labels that are its registrable domain; 0: it has none). The host is
# ``www.shop.<first label of a page host>.<ending>``: plain, wildcard and exception rules, a private suffix (which does
# not count), an international one in both forms, upper case, a trailing dot and an unknown top level.
CASES = (
    ("com", 2), ("co.uk", 3), ("ac.uk.", 3), ("com.au", 3), ("CO.JP", 3), ("co.ck", 3), ("www.ck", 2), ("any.kobe.jp", 4),
    ("kobe.jp", 4), ("city.kobe.jp", 3), ("github.io", 2), ("рф", 2), ("xn--p1ai", 2), ("zzzz", 0),
)


def suffix_domains(spark: SparkSession, d: str) -> DataFrame:
    """The registrable domain of every page's name under every ending."""
    pages = O.page_hosts(table(spark, d, "pages")).select("page_id", F.split("host", r"\.")[0].alias("name"))
    rows = pages.select("page_id", "name", F.posexplode(C.str_array([e for e, _ in CASES])).alias("case", "ending"))
    host = F.concat(F.lit("www.shop."), "name", F.lit("."), "ending")
    rows = rows.select("page_id", "case", host.alias("host"), C.normalize_domain(host).alias("_n"))
    return rows.select("page_id", "case", "host", PSL.registrable_domain("_n").alias("registrable_domain"))


QUERIES = {"suffix_domains": suffix_domains}

_VALUES = ", ".join(f"({i}, '{ending}', {labels})" for i, (ending, labels) in enumerate(CASES))
ORACLE = {"suffix_domains": rf"""
WITH c(k, ending, labels) AS (VALUES {_VALUES}),
p AS (SELECT page_id, string_split(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.')[1] AS name FROM pages),
x AS (SELECT page_id, k, 'www.shop.' || name || '.' || ending AS host, labels,
  string_split(rtrim('shop.' || name || '.' || lower(ending), '.'), '.') AS l FROM p, c)
SELECT page_id, CAST(k AS INTEGER) AS "case", host,
  CASE WHEN labels > 0 THEN array_to_string(l[len(l) - labels + 1:len(l)], '.') END AS registrable_domain FROM x"""}
