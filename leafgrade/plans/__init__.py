"""The registered queries over the reference's operators, each with its DuckDB statement."""
