"""Sensitive-span analytics over document corpora, written for Spark."""
