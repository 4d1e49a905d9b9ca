"""Operators of a large-scale training-data pipeline.

Nothing outside this package imports it: ``__spark_entry__.py`` adds its
queries when the package is present.  ``registry.load_all()`` gives the
queries and their SQL twins.
"""
