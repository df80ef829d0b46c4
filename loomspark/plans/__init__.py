"""Graph, scheduling and runs."""
