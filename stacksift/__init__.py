"""A PySpark-native analytics engine for catalogues, reading logs, search and text corpora."""
