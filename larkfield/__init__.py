"""Subscriber, usage and geographic analytics as PySpark DataFrame operators."""
