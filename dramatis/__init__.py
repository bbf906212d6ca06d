"""Dramatis: role and contact analytics over crawled company pages, on Spark."""
