"""Operators on bars, returns and books, all keyed."""
