"""All queries by name, with the SQL that each must equal."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, sf_dir) function as ``name``; ``sql`` is its DuckDB counterpart."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


from harborline.plans import announcements, archive, audits, benefits, boards, boilerplate, cleanup, deadlines, descriptions, details, education, filters, licences, listing, literals, overviews, places, posting_fields, publishing, records, restatements, rollups, stores, upkeep, validation  # noqa: E402,F401  each registers its queries
