"""The SQL twin of every query, for DuckDB over the same Parquet tables."""

from oracle.sql import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
