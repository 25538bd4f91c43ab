"""Query plans over the analytics tables."""
