"""Operators for the preparation of training text: each module holds one, `queries` registers them all."""
