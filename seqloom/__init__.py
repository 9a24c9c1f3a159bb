"""Lossless approximate matching of query strings against reference sequences, as Spark DataFrame plans."""
