"""Column functions: text, Unicode, dates and romanization."""
