"""PySpark-native analytics, feature and machine-learning stages."""

__version__ = "0.1.0"
