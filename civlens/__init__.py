"""civlens: citizen-report analytics expressed as lazy Spark DataFrame jobs.

Layout
------
sources/    readers, sinks and the role views built over the driver tables
functions/  column-expression builders (dates, text, geometry, fuzzy scores)
operators/  DataFrame -> DataFrame operators (filters, joins, spatial, aggregates,
            windows, quality profiles, features, ML)
plans/      end-to-end jobs composed from operators, and the query catalog
"""

__version__ = "0.1.0"
