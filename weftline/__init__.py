"""weftline: a PySpark-native engine for versioned web datasets."""
