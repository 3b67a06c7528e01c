"""A PySpark-native engine for long-document retrieval, evidence reasoning and corpus preparation."""
