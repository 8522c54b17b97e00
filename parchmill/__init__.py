"""parchmill: a PySpark-native analytics engine for uncertain, line-structured text corpora."""
