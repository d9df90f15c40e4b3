"""Operators for large training-data pipelines.

The rest of the library never imports this subpackage; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
