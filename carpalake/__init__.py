"""carpalake: a PySpark-native engine for skeletal-maturity cohorts and training-data pipelines."""

__version__ = "0.1.0"
