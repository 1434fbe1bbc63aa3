"""Errors a caller may want to tell apart."""


class DatasetNotFound(FileNotFoundError):
    """The telemetry table is not there."""


class ModelNotFound(FileNotFoundError):
    """No trained model has been saved at the path."""


class NoModelChosen(RuntimeError):
    """No candidate reached an F1 above zero, so there is none to save."""
