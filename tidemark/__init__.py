"""tidemark: a Spark-native engine for retrieval and memory analytics over collections of text points."""
