"""What a caller did wrong, by kind."""


class BadRequest(ValueError):
    """The request can't be read or names something that can't be."""


class NotFound(LookupError):
    """No such record."""


class CollectionNotLoaded(LookupError):
    """The named collection isn't held."""


class FormatFailed(RuntimeError):
    """The named format is listed but could not be loaded."""


class InvalidData(ValueError):
    """Input records contradict one another."""
