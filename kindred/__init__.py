"""Kindred: near-duplicate analytics over media and document collections, on Spark."""
