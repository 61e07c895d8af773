"""Table-driven queries, each next to the SQL that states the expected result."""
