"""Spark-native k-mer covariance partitioning and the relational operators around it."""
