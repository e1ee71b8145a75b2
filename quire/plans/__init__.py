"""The catalogue of queries, and the tools that take JSON."""
