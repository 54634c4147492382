"""Errors raised for bad input; both are ``ValueError`` so callers may catch either."""


class InvalidParameter(ValueError):
    """A value, name or file does not fit the project."""


class InvalidOperation(ValueError):
    """The request is well formed but not allowed in the current state."""
