"""What the library raises for bad data."""


class InvalidCategory(ValueError):
    """A categorical value that is not a whole number where one is needed."""


class CardinalityOverLimit(ValueError):
    """More categories, or a larger category id, than allowed."""


class InvalidLabel(ValueError):
    """A label that is missing, not a class, or a class that no row has."""
