"""Settings and errors of a batch run."""

from __future__ import annotations

from dataclasses import dataclass, field

from .operators.languages import resolve_languages
from .operators.signals import QualityConfig


class LeafgradeError(Exception):
    """Base of all errors of this package."""


class ConfigurationError(LeafgradeError):
    """A setting has a value that can't be used."""


class DocumentError(LeafgradeError):
    """A file can't be read."""


class EngineError(LeafgradeError):
    """A text-recognition engine failed; `engine` names it."""

    def __init__(self, engine: str, message: str):
        super().__init__(f"{engine}: {message}")
        self.engine = engine


class MissingDependencyError(LeafgradeError):
    """A plug-in needs something that is not installed."""


class EnvironmentProblems(LeafgradeError):
    """Carries every problem found, not only the first."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass
class RunConfig:
    input_dir: str
    output_dir: str
    quality_threshold: float = 0.85
    #: The first engine reads every file again, not only those with a flagged page.
    force_first: bool = False
    #: The second engine reads every page.
    force_second: bool = False
    max_samples: int = 20
    languages: list[str] = field(default_factory=list)
    #: Files that the first engine reads at a time.
    max_workers: int = 4
    files: list[str] = field(default_factory=list)
    pattern: str = "*.txt"
    recursive: bool = False
    memory_gb: float = 16.0
    device: str = "cpu"
    #: An engine that fails on its device fails the batch, instead of going on without that device.
    strict_device: bool = False
    extract_text: bool = False
    copy_sources: bool = False
    diagnostics: bool = False
    keep_intermediates: bool = False

    def quality(self) -> QualityConfig:
        if not 0 <= self.quality_threshold <= 1:
            raise ConfigurationError(f"threshold {self.quality_threshold} is not in [0, 1]")
        return QualityConfig(threshold=self.quality_threshold, max_samples=self.max_samples)

    def engine_languages(self) -> tuple[str, str]:
        return resolve_languages(self.languages)


def worker_sizes(cores: int, files: int, max_workers: int) -> tuple[int, int]:
    """Jobs for each file and files at a time."""
    jobs = max(1, cores // max(1, files))
    return jobs, max(1, min(max_workers, cores // jobs))
