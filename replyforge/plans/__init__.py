"""Whole jobs, the stand-in views over the test tables, and the query catalogue."""
