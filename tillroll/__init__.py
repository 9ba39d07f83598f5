"""tillroll: retail transaction analytics as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function built from native Spark SQL
expressions. Most accept an optional ``by`` list of grouping keys so that one job can
compute the figures of many businesses (tenants, regions, datasets) at once.
"""

__version__ = "0.1.0"
