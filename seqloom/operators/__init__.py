"""Operators: lazy DataFrame -> DataFrame functions, one per inventory entry."""
