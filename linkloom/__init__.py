"""A Spark-native engine for web graphs: links, versioned graphs and PageRank as DataFrame plans."""
