"""Readers, generators and sinks of graphs, matrices, configurations, traces and metrics."""
