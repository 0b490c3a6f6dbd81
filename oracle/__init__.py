"""DuckDB oracle: the report's semantics as plain SQL over the driver's tables.

Used only for checking: ``__spark_entry__.oracle_sql()`` hands these strings to
the driver, which runs them beside the Spark queries.
"""
