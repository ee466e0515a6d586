"""The registered queries: each module maps names to (Spark query, DuckDB SQL or None)."""
