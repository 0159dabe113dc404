"""The comparison with DuckDB that all tests share."""

from tests.oracle import duck, norm, same  # noqa: F401
