"""Column expressions: keys, geometry, kernels, durations."""
