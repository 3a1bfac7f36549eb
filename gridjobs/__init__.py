"""Spark jobs over gridded environmental and biodiversity tables."""
