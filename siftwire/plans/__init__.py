"""Composed plans and the registered queries of the core."""
