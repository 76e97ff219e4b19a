"""Column builders: extraction rules and path helpers."""
