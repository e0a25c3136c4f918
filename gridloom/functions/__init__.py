"""Column functions: tags, text, geometry."""
