"""Spark-native feature engineering, scorecard statistics and model blending for binary classification."""
