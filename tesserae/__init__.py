"""Tesserae: a statistics-design advisor and analytics library on Spark DataFrames."""
