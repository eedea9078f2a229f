"""Operators: DataFrame -> DataFrame, usable with ``.transform``."""
