"""Streaming of the dataflow engine."""
