"""galley: medallion tables, a star schema, named measures and quality checks on Spark.

The package is organised by the kind of thing a user reaches for:

``galley.sources``    read, write, probe and generate tables
``galley.functions``  column expressions (casts, date parts, safe ratios, draws)
``galley.operators``  DataFrame -> DataFrame building blocks (dedup, keys, lookups, checks)
``galley.plans``      composed jobs (silver, gold, measures, reports, whole pipeline)
"""

__version__ = "0.1.0"
