"""Operators that prepare training corpora; see each module's docstring."""
