"""Workflows that compose the operators, and the queries that exercise them on the driver's tables."""
