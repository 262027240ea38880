"""Functions of spliceframe."""
