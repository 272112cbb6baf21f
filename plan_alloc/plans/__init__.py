"""Compositions of the operators: the end-to-end job, its command line, the
registered queries and their DuckDB oracle SQL."""
