"""The catalogue: code-graph questions, and the registered queries with their SQL."""
