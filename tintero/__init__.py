"""Spark-native operators for serialized-fiction corpora: extraction, normalisation, audit and book algebra."""
