"""Column functions: rates, names, dates and text rules."""
