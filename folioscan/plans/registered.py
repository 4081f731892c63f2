"""All registered queries and their SQL: importing a module of queries registers them."""

from folioscan.plans import lookups, passages, queries, texts

MODULES = (queries, lookups, passages, texts)
QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
