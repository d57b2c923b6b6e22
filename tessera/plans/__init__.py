"""Statements, their parser and the compiler to DataFrames."""
