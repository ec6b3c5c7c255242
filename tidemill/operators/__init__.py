"""Graph, matrix, schedule, metric and comparison operators."""
