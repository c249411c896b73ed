"""Column expressions: text, URL, label and vector helpers."""
