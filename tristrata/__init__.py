"""Medallion analytics on Spark: staging, star schemas, aggregates, checks and metrics as DataFrame functions."""
