"""A Spark-native engine for analysing page-structured documents."""
