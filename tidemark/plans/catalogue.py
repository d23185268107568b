"""The reference operators' queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from tidemark.plans import audits, flows, learning, lookups, market, selection, tables

QUERIES: dict = {**market.QUERIES, **learning.QUERIES, **lookups.QUERIES, **flows.QUERIES, **tables.QUERIES, **audits.QUERIES, **selection.QUERIES}
ORACLE_SQL: dict = {**market.ORACLE_SQL, **learning.ORACLE_SQL, **lookups.ORACLE_SQL, **flows.ORACLE_SQL, **tables.ORACLE_SQL, **audits.ORACLE_SQL}
