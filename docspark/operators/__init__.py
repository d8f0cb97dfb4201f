"""Operators that are more than an expression: INCLUDE and changes of collections."""
