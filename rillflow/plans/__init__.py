"""Plans of the dataflow engine."""
