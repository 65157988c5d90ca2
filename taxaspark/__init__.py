"""Spark-first engine for read-level microbial signal reconstruction."""
