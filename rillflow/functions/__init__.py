"""Functions of the dataflow engine."""
