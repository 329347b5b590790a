"""Training-data operators: scoring, language, duplicates, contamination, formatting and mixing.

Nothing else in the library imports this subpackage; ``__spark_entry__`` adds
its queries only where it can be imported.
"""
