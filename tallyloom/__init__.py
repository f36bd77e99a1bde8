"""A Spark-native engine for record linkage, rules, rendering, gates and evaluation."""
