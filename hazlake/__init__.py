"""Spark library for analysing free-text operational safety reports."""
