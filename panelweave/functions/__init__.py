"""Column-level functions: missing-value rules, labels, projections, distributions."""
