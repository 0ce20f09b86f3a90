"""Readers and parsers that turn files and rows into DataFrames."""
