"""Plumbline: model monitoring and drift analytics on Apache Spark."""
