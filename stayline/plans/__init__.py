"""Compositions of operators: profiles, matrices, models and reports."""
