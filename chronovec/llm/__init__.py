"""Training-data operators: one module per operator, thin queries beside them.

Nothing outside this subpackage imports it.
"""
