"""PySpark-native retrieval analytics: index building, search, pruning, sharding, features."""
