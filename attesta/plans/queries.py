"""Imports every query module, so that RUN and SQL are complete."""

from attesta.plans import (  # noqa: F401
    record_queries, report_queries, search_queries, source_queries, state_queries, stream_queries,
)
from attesta.plans.registry import RUN, SQL  # noqa: F401
