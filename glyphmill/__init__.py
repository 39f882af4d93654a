"""Document-component analytics on Spark: geometry, routing, matching, metrics, reports, annotation ETL and rasters."""
