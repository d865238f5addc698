"""Thicket: structural search over text and source files, built on DataFrames."""

__version__ = "0.1.0"
