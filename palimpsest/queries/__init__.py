"""Queries over the bound tables, each with the SQL it must agree with."""
