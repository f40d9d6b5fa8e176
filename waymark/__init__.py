"""Landmark evaluation of early-warning predictions as Spark DataFrame plans."""
