"""siftstone: a Spark-native engine for knowledge retrieval, graph analytics and corpus preparation."""
