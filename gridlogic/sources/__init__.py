"""Sources of the layout engine."""
