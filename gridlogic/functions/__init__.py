"""Functions of the layout engine."""
