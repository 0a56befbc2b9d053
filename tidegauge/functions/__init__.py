"""Column expressions and small DataFrame helpers the operators share."""
