"""A PySpark toolkit for tables and event logs."""
