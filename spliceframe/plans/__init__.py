"""Plans of spliceframe."""
