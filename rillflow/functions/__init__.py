"""Functions on weighted rows, intervals and tolerant numbers."""
