"""quillon: a Spark-native engine for schema-first, single-entity querying."""
