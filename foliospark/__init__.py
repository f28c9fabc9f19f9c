"""Foliospark: analytics over recorded web pages, written as Spark DataFrame plans."""
