"""A Spark-native engine for k-mer tables and compacted de Bruijn graphs."""
