"""Index mode: queries answered from persisted postings instead of the texts."""

from docsieve.operators.inverted import IndexEngine, InvertedIndex, commit, merge

__all__ = ["IndexEngine", "InvertedIndex", "commit", "merge"]
