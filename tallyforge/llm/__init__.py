"""Operators for preparing training text: thirteen components and the helpers they share.

Nothing else in the library imports this subpackage.
"""
