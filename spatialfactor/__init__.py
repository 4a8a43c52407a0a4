"""A PySpark-native engine for spatial, multi-sample matrix factorisation and the analytics around it."""
