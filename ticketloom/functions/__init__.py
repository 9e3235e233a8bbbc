"""Column functions: normalisation, text and vectors."""
