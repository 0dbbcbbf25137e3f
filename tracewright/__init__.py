"""tracewright: a PySpark-native engine for session-log analytics."""
