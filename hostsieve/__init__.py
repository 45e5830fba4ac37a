"""Log analytics for domain names on Spark: parsing, batching, scoring, detection and training as DataFrame operators."""
