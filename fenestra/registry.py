"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from fenestra.plans import aggregates, cascades, checks, facets, joins, loads, normalisers, resolvers, scalars, state

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (facets, scalars, joins, resolvers, aggregates, state, checks, loads, normalisers, cascades):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
