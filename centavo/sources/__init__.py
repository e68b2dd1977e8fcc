"""Sources: canonical tables, statement files."""
