"""Query definitions."""
