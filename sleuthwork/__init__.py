"""A PySpark-native engine for evidence-constrained incident analysis."""
