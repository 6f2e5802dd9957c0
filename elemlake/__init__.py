"""elemlake: a PySpark-native engine for versioned, hierarchical element data."""
