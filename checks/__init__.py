"""Check data, registered queries and their DuckDB counterparts."""
