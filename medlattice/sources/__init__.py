"""Readers that turn external files into typed DataFrames."""
