"""Operators over event logs; every function takes and returns DataFrames."""
