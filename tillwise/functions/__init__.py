"""Column expressions and ranking shared by the operators."""
