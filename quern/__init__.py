"""quern: Spark-native analytics over labelled-text generation experiments."""
