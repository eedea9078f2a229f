"""Registered queries: each operator run on the given tables, beside the SQL that must agree."""
