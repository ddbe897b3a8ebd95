"""weftgraph: a Spark-native engine for source-code and dependency-graph analytics."""
