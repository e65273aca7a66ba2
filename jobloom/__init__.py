"""Listings analytics on Spark."""
