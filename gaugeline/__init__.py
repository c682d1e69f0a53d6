"""Gaugeline: multi-tenant metering on Spark."""
