"""Lazy normalized matrices and what can be done with them."""
