"""auditlake: a Spark-native engine for website-audit tables and training-text pipelines."""
