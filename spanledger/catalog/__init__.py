"""Registered queries: each catalog module pairs a Spark query with plain SQL over the same tables."""
