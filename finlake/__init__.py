"""finlake: PySpark jobs for financial and civic event data."""
