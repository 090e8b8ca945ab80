"""loomwright: a Spark-native knowledge-base and text analytics engine."""
