"""Relational and temporal operators over content tables."""
