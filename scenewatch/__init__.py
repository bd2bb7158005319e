"""Spark jobs for monitoring land from satellite scenes."""
