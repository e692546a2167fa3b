"""Plans of the layout engine."""
