"""Relational operators, parameterised by column names."""
