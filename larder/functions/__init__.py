"""Column builders: rounding, text, keyword rules and nutrition formulas."""
