"""textmill: a Spark-native engine for building, cleaning, auditing and evaluating text corpora."""
