"""Training-data operators: ten large-scale corpus operators and the queries that apply them.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
