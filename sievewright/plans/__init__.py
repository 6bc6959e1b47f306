"""Predicates and the two routes that answer them."""
