"""Run-time and origin columns that every lake row carries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_KEYS = ("processing_time", "source_database")
#: Ends the label of a run that holds only what is new since the run before; the label still sorts by time.
INCREMENT = "-increment"


def run_time_label(moment: datetime | None = None) -> str:
    """One UTC label per run, shared by all its tables; sorts by time, needs no escaping in a folder name."""
    moment = moment or datetime.now(UTC)
    return moment.astimezone(UTC).strftime("%Y%m%dT%H%M%SZ")


def audit_columns(df: DataFrame, run_time: str, source_database: str, source_table: str) -> DataFrame:
    return df.withColumns(
        {
            "processing_time": F.lit(run_time),
            "source_database": F.lit(source_database),
            "source_table": F.lit(source_table),
        }
    )
