"""A PySpark-native engine for searching, analysing and preparing document corpora."""
