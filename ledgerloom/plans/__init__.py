"""Expansion of nested plans into rows."""
