"""newsmill: a PySpark-native engine for auditable news-intelligence pipelines."""
