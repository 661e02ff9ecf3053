"""Reports composed from the operators: cost, fleet list, health, diagnosis, benchmarks, estimate."""
