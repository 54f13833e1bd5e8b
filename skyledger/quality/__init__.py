"""Declarative data quality: constraints, configured rules, verification, profiles and suggestions."""
