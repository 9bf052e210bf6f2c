"""Citable retrieval analytics and training-data operators as Spark plans."""
