"""tidemark: panel cleaning, enrichment and forecasting as Spark jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function whose columns are
parameters, so it runs on any panel (series key, date, target, covariates).
"""

__version__ = "0.1.0"
