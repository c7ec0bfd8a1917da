"""feedloom: feed ingestion, enrichment stages, artifacts, a property graph
and benchmark statistics as Spark DataFrame jobs."""

__version__ = "0.1.0"
