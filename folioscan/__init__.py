"""folioscan: Spark-native search, ranking and extraction over text corpora."""
