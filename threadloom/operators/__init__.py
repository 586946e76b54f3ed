"""Relational operators of the engine (D, I, G, B, R, M series)."""
