"""Sheetweave: engineering-drawing analytics as PySpark DataFrame operators."""
