"""Training-data operators: one module for each, plus ``queries`` which registers them.

Nothing else in the library imports this subpackage.
"""
