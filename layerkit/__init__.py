"""Layered table toolkit: plain ``DataFrame -> DataFrame`` functions for Spark."""

__version__ = "0.1.0"
