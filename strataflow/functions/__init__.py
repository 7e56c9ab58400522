"""Column functions: pure expressions over column names or columns, kept inside code generation."""
