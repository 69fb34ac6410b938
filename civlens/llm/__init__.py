"""Operators for training-data pipelines: filtering, de-duplication, mixing, packing, output.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it can be
imported. Each module holds one operator; ``queries`` registers the thin ``opN_*`` queries.
"""
