"""Table operators: domain, cells, walks, partitioning, integration, checks."""
