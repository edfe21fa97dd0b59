"""Column expressions shared by sources and operators."""
