"""A data-frame analytics engine over Spark: ingest, expressions, statistics, models, scoring."""
