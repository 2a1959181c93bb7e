"""Typed errors with exit codes; everything fails closed."""


class ProvenaError(Exception):
    exit_code = 70


class ConfigurationError(ProvenaError, ValueError):
    exit_code = 10


class BoundaryError(ConfigurationError):
    """A path or limit that leaves what is declared."""


class TaskError(ProvenaError):
    exit_code = 20


class EvidenceError(ProvenaError):
    exit_code = 30
