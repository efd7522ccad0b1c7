"""Whole runs built from the operators."""

from .job import ReshapeJob

__all__ = ["ReshapeJob"]
