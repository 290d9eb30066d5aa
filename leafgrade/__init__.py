"""Document-quality analytics on PySpark."""

from .config import ConfigurationError, DocumentError, EngineError, EnvironmentProblems, LeafgradeError, MissingDependencyError, RunConfig
from .events import Event, Receiver, to_log
from .operators.languages import resolve_languages

__version__ = "0.2.0"

__all__ = [
    "ConfigurationError",
    "DocumentError",
    "EngineError",
    "EnvironmentProblems",
    "Event",
    "LeafgradeError",
    "MissingDependencyError",
    "Receiver",
    "RunConfig",
    "resolve_languages",
    "to_log",
]
