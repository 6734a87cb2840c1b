"""A PySpark-native engine that finds, redacts, audits and evaluates sensitive data in documents."""
