"""Every query of the reference operators over the test tables: the Spark callable and, where SQL can express it, the DuckDB text."""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
