"""Readers that turn profiler text, traces and counters into typed DataFrames."""
