"""Inputs beyond those Spark reads itself."""
