"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; ``llm.queries`` registers
its queries and ``__spark_entry__.py`` adds them when the subpackage exists.
"""
