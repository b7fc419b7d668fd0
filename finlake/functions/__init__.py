"""Column expressions shared by the operators; no UDFs."""
