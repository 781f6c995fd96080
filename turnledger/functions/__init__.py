"""Column expressions; nothing here triggers a shuffle."""
