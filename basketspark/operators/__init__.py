"""Operators over offers, cards, prices, carts and recipes: DataFrames in, DataFrames out."""
