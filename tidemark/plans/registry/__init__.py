"""Queries by family, each with the DuckDB SQL that states the same result."""
