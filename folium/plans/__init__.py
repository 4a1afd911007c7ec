"""Registry of the queries: each operator module registers a builder and, where SQL expresses it, the SQL."""
