"""Column functions: scalar rules that stay inside generated code."""
