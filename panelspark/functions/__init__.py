"""Column and frame functions: scalars, windows, events, recursions, order statistics."""
