"""Road-charge analytics on Spark: event ingest, star-schema mart, KPI reads, quality gate."""
