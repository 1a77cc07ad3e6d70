"""parlance: a PySpark-native engine for curating and querying conversational text corpora."""
