"""The queries of this subpackage and the DuckDB SQL that each must equal."""

from __future__ import annotations

from fernquery.llm import contracts


def queries():
    return dict(contracts.QUERIES)


def oracle_sql():
    return dict(contracts.ORACLES)
