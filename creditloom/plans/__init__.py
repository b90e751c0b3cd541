"""The concrete feature sets and the wide table built from them."""
