"""Registered queries over the sample tables and the SQL they must agree with."""
