"""Distributed-tracing span analytics as Spark DataFrame operators."""
