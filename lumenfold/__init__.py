"""Spark-first screening of scientific figure collections, and the corpus operators beside it."""
