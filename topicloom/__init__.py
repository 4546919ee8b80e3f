"""Topicloom: text clustering and topic analytics on Spark DataFrames."""

__version__ = "0.1.0"
