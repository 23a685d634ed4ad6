"""Queries over the tables of TESTDATA.md, each paired with the SQL that must give the same rows."""
