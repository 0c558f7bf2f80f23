"""Raw record lines derived from the driver tables, in tasks of a bounded number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scanmart.operators import observations as O
from scanmart.plans.rich import rich_records
from scanmart.sources import ndjson as N
from scanmart.sources.tables import table


def dealt_events(spark: SparkSession, d: str) -> DataFrame:
    return N.dealt(table(spark, d, "events"))


def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """(sequence, value): the raw record of every observation derived from the tables.

    The events are dealt out before their joins, and the joined rows again before their texts are made and
    parsed: where a join shuffles, its key and the sizes alone would say how many rows a task gets."""
    events = dealt_events(spark, d)
    obs = O.adapter_observations(events, table(spark, d, "pages"), table(spark, d, "nation"))
    return O.raw_records(N.spread(O.with_orgs(obs, table(spark, d, "customer")), N.tasks_for(table(spark, d, "events"))))


def rich_lines(spark: SparkSession, d: str) -> DataFrame:
    """(sequence, value): the record with every field and odd shapes of each event."""
    return rich_records(dealt_events(spark, d))
