"""Sources of the dataflow engine."""
