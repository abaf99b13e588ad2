"""Column expressions and aggregate building blocks shared by all operators."""
