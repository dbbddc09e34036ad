"""Photovoltaic telemetry fault analytics as Spark jobs."""
