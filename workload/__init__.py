"""Benchmark and correctness workload: input views, queries and check SQL."""
