"""Column helpers: normalised keys, validators, text, dates, field extraction."""
