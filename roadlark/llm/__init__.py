"""Operators for preparing training data: quality, de-duplication, packing, archives, models.

Nothing else in the library imports this subpackage.
"""
