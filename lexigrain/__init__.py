"""Lexigrain: document and table analytics expressed as Spark plans."""
