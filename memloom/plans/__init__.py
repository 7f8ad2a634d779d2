"""Registered queries, their fixtures and the SQL that they are checked against."""
