"""pagelake: a Spark-native engine for auditing captured web pages and sites."""
