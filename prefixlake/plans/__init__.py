"""Operators joined into whole queries."""
