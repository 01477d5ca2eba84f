"""Spark-first comparison of two versions of a relational data set."""
