"""Regression-discontinuity analytics for ranked vocabularies, as PySpark DataFrame operators."""
