"""What the layer raises; each is also the built-in error a caller would expect."""


class ModelError(ValueError):
    """A declaration that cannot stand."""


class FieldError(KeyError, ValueError):
    """A name that the model does not have."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


class LookupSyntaxError(ValueError):
    """A lookup that cannot be read, or a value that does not fit it."""


class DataError(ValueError):
    """Rows that the model does not accept."""


class GuardError(PermissionError):
    """A change that the settings forbid."""
