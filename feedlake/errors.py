"""Errors a store raises."""


class StoreError(Exception):
    """Base of all errors of a store."""


class InvalidConfig(StoreError, ValueError):
    """A configuration with everything that is wrong with it."""


class VersionConflict(StoreError):
    """A partition is not at the version the writer expected."""


class LockNotInTransaction(StoreError):
    """A partition lock was asked for outside a transaction."""


class LockTimeout(StoreError):
    """A partition lock was not free in time."""


class MetadataTooLarge(StoreError, ValueError):
    """A file's metadata does not fit the sidecar's limit."""


class SchemaMismatch(StoreError):
    """A store on disk that does not fit its configuration; lists everything missing."""


class ForeignFile(StoreError, ValueError):
    """A file reference that is not under the store's data folder."""


class LockLost(StoreError):
    """A partition lock lapsed before its transaction was done."""


class IntegrityError(StoreError, OSError):
    """A file is not what was written."""


class NoSession(StoreError, ValueError):
    """A store was opened without a session."""
