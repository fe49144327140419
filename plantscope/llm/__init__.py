"""Operators that prepare text, pages and vectors for training. Nothing else in the library imports them."""
