"""Tracking analytics and sanitization of URLs, HTML and email on Spark."""
