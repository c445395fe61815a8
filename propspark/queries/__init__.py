"""Every operator applied to the driver's tables, beside an independent SQL form."""

from propspark.queries import jobs, joins, models, reports, rows, sources, streaming, windows  # noqa: F401
from propspark.queries.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
