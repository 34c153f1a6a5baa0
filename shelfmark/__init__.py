"""Resolution of large file catalogues on Spark: parsing, grouping, deduplication, classification, reports."""
