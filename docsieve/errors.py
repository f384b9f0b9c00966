"""Errors that a caller may see."""


class SearchError(ValueError):
    """A request that cannot be answered."""


class UnsupportedQuery(SearchError):
    """Syntax outside the supported grammar."""
