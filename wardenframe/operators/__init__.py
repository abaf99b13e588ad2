"""Domain operators, each a DataFrame -> DataFrame function."""
