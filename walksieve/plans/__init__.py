"""Chains of operators over stored stage tables."""
