"""Spark-native trajectory analytics: episodes, frames and images as DataFrames."""
