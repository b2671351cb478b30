"""All core queries by name."""

from chronolens.plans import analytics, ingest, lookups, recall, search, search_each, upkeep

QUERIES = {**upkeep.QUERIES, **analytics.QUERIES, **lookups.QUERIES, **search.QUERIES, **search_each.QUERIES, **recall.QUERIES, **ingest.QUERIES}
ORACLE = {**upkeep.ORACLE, **analytics.ORACLE, **lookups.ORACLE, **search.ORACLE, **search_each.ORACLE, **recall.ORACLE, **ingest.ORACLE}
