"""A PySpark engine for price-table intelligence."""
