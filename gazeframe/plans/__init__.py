"""Whole reports and the registered queries."""
