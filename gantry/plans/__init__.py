"""KPI reads, lookups and the nightly job."""
