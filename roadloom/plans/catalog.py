"""The registered queries of the network engine and their DuckDB counterparts."""

from __future__ import annotations

from . import airports, calibration, contracts, geometry, network, relational, routing

QUERIES: dict = {**relational.QUERIES, **network.QUERIES, **routing.QUERIES, **contracts.QUERIES, **geometry.QUERIES, **calibration.QUERIES, **airports.QUERIES}
ORACLE_SQL: dict = {**relational.SQL, **network.SQL, **routing.SQL, **contracts.SQL, **geometry.SQL, **calibration.SQL, **airports.SQL}
flagship = routing.c5
