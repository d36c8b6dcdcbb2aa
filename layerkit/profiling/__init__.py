"""Table profiler: statistics, keys, patterns, findings and type inference."""
