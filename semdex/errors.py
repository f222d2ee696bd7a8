"""What can go wrong, by layer."""


class SemdexError(Exception):
    """Base of all errors that are the user's to mend."""


class StoreError(SemdexError):
    """The index can't be read or written, or a name or path is taken."""


class DimensionMismatchError(StoreError):
    """Vectors of another width than the index holds; a full re-index mends it."""


class ProviderError(SemdexError):
    """An embedding provider failed."""


class ConfigError(SemdexError):
    """The configuration is invalid or a key is unknown."""


class ChunkError(SemdexError):
    """A file can't be split; it is skipped."""
