"""casegraph: a Spark-native code-audit analytics engine."""
