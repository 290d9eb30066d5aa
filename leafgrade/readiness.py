"""Whether engines can run where they will run: tools, language packs, folders, devices and memory.

Probes are plain functions, so plug-ins bring their own; check_executors runs them on the cluster's workers.
"""

from __future__ import annotations

import importlib.util
import os
import resource
import shutil
import socket
import subprocess
import sys
import tempfile
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .config import EnvironmentProblems, MissingDependencyError

GIB = 1 << 30


@dataclass(frozen=True)
class Needs:
    """What an engine needs: programs on the path, modules, language packs (with a command that lists them), a writable folder."""

    programs: tuple[str, ...] = ()
    modules: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    list_languages: tuple[str, ...] = ()
    folder: str | None = None


def has_module(name: str) -> bool:
    """Whether a module could be imported, without importing it."""
    try:
        return importlib.util.find_spec(name) is not None
    except (ImportError, ValueError):
        return False


def require(name: str) -> None:
    if not has_module(name):
        raise MissingDependencyError(f"module {name} is not installed")


def output_lines(command: tuple[str, ...], seconds: float = 10) -> list[str]:
    """The lines that a command prints to either stream; OSError or SubprocessError if it can't run."""
    done = subprocess.run(command, capture_output=True, text=True, timeout=seconds)
    return [x.strip() for x in (done.stdout or done.stderr).splitlines() if x.strip()]


def version_of(program: str) -> str:
    """The first line that `program --version` prints, or `unknown`."""
    try:
        return next(iter(output_lines((program, "--version"))), "unknown")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def problems(needs: Needs) -> Iterator[str]:
    """Everything that is missing here, one line each."""
    for program in needs.programs:
        if shutil.which(program) is None:
            yield f"program {program} is not on the path"
    for module in needs.modules:
        if not has_module(module):
            yield f"module {module} is not installed"
    if needs.languages and needs.list_languages:
        try:
            there = set(output_lines(needs.list_languages))
            yield from (f"language pack {x} is not installed" for x in needs.languages if x not in there)
        except (OSError, subprocess.SubprocessError) as e:
            yield f"language packs can't be listed: {e}"
    folder = needs.folder or tempfile.gettempdir()
    try:
        with tempfile.TemporaryFile(dir=folder):
            pass
    except OSError:
        yield f"folder {folder} is not writable"


def validate(needs: Needs) -> None:
    """Raises EnvironmentProblems with all of them."""
    if found := list(problems(needs)):
        raise EnvironmentProblems(found)


def check_executors(spark: SparkSession, needs: Needs, tasks: int = 64) -> DataFrame:
    """Rows (host, problem) of the workers that `tasks` tasks meet; none if all are ready."""

    def run(batches):
        for batch in batches:
            found = [(socket.gethostname(), x) for x in problems(needs)]
            yield pd.DataFrame(found if len(batch) else [], columns=["host", "problem"])

    return spark.range(tasks).repartition(tasks).mapInPandas(run, "host string, problem string").distinct()


@dataclass(frozen=True)
class Device:
    name: str
    #: The better device that is there but could not be used, if any.
    instead_of: str | None = None


#: Order in which devices are tried.
DEVICES = ("cuda", "mps", "cpu")


def _torch_probe(name: str) -> Callable[[], bool | None]:
    def probe() -> bool | None:
        if not has_module("torch"):
            return None
        import torch

        there = torch.cuda.is_available() if name == "cuda" else torch.backends.mps.is_available()
        if not there:
            return None
        try:
            torch.zeros(1, device=name)
        except RuntimeError:
            return False
        return True

    return probe


def default_probes() -> dict[str, Callable[[], bool | None]]:
    """For each device but the processor: None if it is not there, else whether it can be used."""
    return {name: _torch_probe(name) for name in DEVICES[:-1]}


def choose_device(probes: Mapping[str, Callable[[], bool | None]] | None = None, strict: bool = False) -> Device:
    """The first device that can be used; with strict, a device that is there but fails is an error."""
    failed = None
    for name in DEVICES[:-1]:
        usable = (probes if probes is not None else default_probes()).get(name, lambda: None)()
        if usable:
            return Device(name, failed)
        if usable is False:
            if strict:
                raise EnvironmentProblems([f"device {name} is there but can't be used"])
            failed = failed or name
    return Device("cpu", failed)


def device_status(device: Device) -> str:
    if device.name != "cpu":
        return f"using {device.name}"
    return f"{device.instead_of} can't be used, using the processor" if device.instead_of else "no device found, using the processor"


def memory_gb(device: str = "cpu") -> float:
    """Memory of the first cuda device, else (or where that can't be told) all of this machine's."""
    if device == "cuda" and has_module("torch"):
        import torch

        try:
            return torch.cuda.get_device_properties(0).total_memory / GIB
        except (RuntimeError, AssertionError):
            pass
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") / GIB


def memory_report(device: str = "cpu") -> dict[str, float | str]:
    """Memory held by this process and by its device, in MB."""
    unit = 1 if sys.platform == "darwin" else 1024
    out: dict[str, float | str] = {"device": device, "process_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * unit / 2**20, 2), "allocated_mb": 0.0, "reserved_mb": 0.0}
    if device in ("cuda", "mps") and has_module("torch"):
        import torch

        if device == "cuda":
            out |= {"allocated_mb": round(torch.cuda.memory_allocated() / 2**20, 2), "reserved_mb": round(torch.cuda.memory_reserved() / 2**20, 2)}
        else:
            out["allocated_mb"] = round(torch.mps.current_allocated_memory() / 2**20, 2)
    return out
