"""Postloom: mail-archive and training-data analytics expressed as Spark plans."""
