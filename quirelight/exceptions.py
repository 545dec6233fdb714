"""Errors of the engine."""


class ConversionError(Exception):
    """A document can't be converted."""


class EmptyPageConversionError(ConversionError):
    """A page has nothing to convert."""
