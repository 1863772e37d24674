"""gleanworks: a Spark-native evidence retrieval and corpus engine."""
