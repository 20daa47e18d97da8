"""Every operator as a query over the given tables, with the SQL that must agree."""
from paneltide.catalog import asof, build, model, quality, rebuilt, resample, validate  # noqa: F401
from paneltide.catalog.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
