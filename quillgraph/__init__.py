"""quillgraph: a Spark-native engine for event-sourced project memory and large-scale text data."""
