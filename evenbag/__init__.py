"""evenbag: row-preserving relational rewrites, checked as bags, on Spark."""
