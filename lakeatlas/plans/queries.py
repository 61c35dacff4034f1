"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from . import catalogue, checks, configs, details, documents, extraction, fleet, rules, snapshots

QUERIES: dict = {**catalogue.QUERIES, **documents.QUERIES, **checks.QUERIES, **extraction.QUERIES, **details.QUERIES, **configs.QUERIES, **snapshots.QUERIES, **fleet.QUERIES, **rules.QUERIES}
ORACLES: dict[str, str] = {**catalogue.ORACLES, **documents.ORACLES, **checks.ORACLES, **extraction.ORACLES, **details.ORACLES, **configs.ORACLES, **snapshots.ORACLES, **fleet.ORACLES, **rules.ORACLES}
