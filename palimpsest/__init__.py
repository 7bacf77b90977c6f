"""Versioned tables and relational analytics for Apache Spark."""
