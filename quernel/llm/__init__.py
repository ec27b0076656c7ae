"""Operators for training-data pipelines over documents, pages and vectors.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its
queries only where the folder exists.
"""
