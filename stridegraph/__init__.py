"""stridegraph: a Spark-native engine for regular graphs and sets of stepped intervals."""
