"""Column expressions and name rules shared by the operators."""
