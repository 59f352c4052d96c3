"""Dataset normalisation and publication as Spark DataFrame jobs."""

from gridpress.model import Column, Definition, FilterRule, SortRule
from gridpress.operators.view import view

__all__ = ["Column", "Definition", "FilterRule", "SortRule", "view"]
