"""All registered queries and their SQL forms."""

from . import (alarm_queries, facts_queries, ingest_queries, ledger_queries,  # noqa: F401
               reliability_queries, stream_queries, view_queries)
from .base import QUERIES, oracles  # noqa: F401
