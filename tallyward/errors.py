"""Errors raised by the guards around operators."""


class ResourceLimitError(Exception):
    """A size, row, step or time limit was hit."""


class QuotaExceededError(ResourceLimitError):
    """A tenant is over its daily quota."""


class TenantContextError(PermissionError):
    """An operation that must be scoped to a tenant got none."""
