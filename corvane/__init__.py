"""Corvane: point-in-time panel analytics and corpus preparation on Spark."""
