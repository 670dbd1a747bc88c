"""Column expressions: scoring ladders, token estimates, snippets, JSON normalisation."""
