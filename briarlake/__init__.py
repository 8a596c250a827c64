"""A PySpark-native engine that builds, audits and scores multiple-choice cause benchmarks."""
