"""Forkline: differential usage of alternative paths, as PySpark DataFrame operators."""
