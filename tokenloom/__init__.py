"""Tokenizer, codec and corpus operators as PySpark DataFrame transformations."""
