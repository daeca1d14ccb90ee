"""Longitudinal health-record analytics as declarative Spark plans."""
