"""Registered queries: the operators applied to the test tables, with reference SQL."""
