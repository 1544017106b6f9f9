"""Settings. Only keys that do something are accepted; unknown ones, and those that Spark decides itself, are reported."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from pathlib import Path

_BOOLS = {"enableMasking": "enable_masking", "maskInEnvironments": "mask_in_environments", "cpu.multithreading.enabled": "multithreading", "gpu.inference.enabled": "gpu", "enableFallback": "enable_fallback", "maskOrphanInside": "mask_orphan_inside"}
_TEXTS = {"mode": "mode", "tokenizerPath": "tokenizer_path", "modelPath": "model_path", "log.file": "log_file"}
MODES = ("CPU_SINGLE", "CPU_MULTI", "GPU", "KAFKA")


@dataclass(frozen=True)
class Config:
    mode: str = "CPU_SINGLE"
    max_threads: int = 8
    enable_masking: bool = True
    mask_in_environments: bool = True
    multithreading: bool = False
    gpu: bool = False
    tokenizer_path: str | None = None
    model_path: str | None = None
    log_file: str = "application.log"
    enable_fallback: bool = True  # the rule patterns, before any model span
    mask_orphan_inside: bool = False
    kafka: dict[str, str] = field(default_factory=dict)

    @property
    def threads(self) -> int:
        """Threads of one task's model: more than one only if multithreading is on. Spark runs tasks side by side anyway."""
        return max(1, self.max_threads) if self.multithreading or self.mode == "CPU_MULTI" else 1

    @property
    def on_gpu(self) -> bool:
        return self.gpu or self.mode == "GPU"

    @classmethod
    def from_properties(cls, values: dict[str, str], prefix: str = "") -> Config:
        """From flat string properties; `prefix` (with its dot) is cut off keys that have it, others are left out."""
        own = strip_prefix(values, prefix)
        kafka = strip_prefix(own, "kafka.")
        args: dict = {"kafka": kafka}
        for key, value in own.items():
            if key in _BOOLS:
                args[_BOOLS[key]] = value.strip().lower() == "true"
            elif key in _TEXTS:
                args[_TEXTS[key]] = value
            elif key == "maxCpuThreads":
                args["max_threads"] = int(value)
            elif not key.startswith("kafka."):
                warnings.warn(f"unknown setting {key}", stacklevel=2)
        mode = args.get("mode", "CPU_SINGLE").upper()
        args["mode"] = mode if mode in MODES else "CPU_SINGLE"
        return cls(**args)

    @classmethod
    def load(cls, *paths: str, prefix: str = "") -> Config:
        """From the first of the files that exists."""
        for p in paths:
            if Path(p).exists():
                return cls.from_properties(parse_properties(Path(p).read_text()), prefix)
        raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def parse_properties(text: str) -> dict[str, str]:
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if line and line[0] not in "#!":
            cut = min((i for i in (line.find("="), line.find(":")) if i >= 0), default=len(line))
            out[line[:cut].strip()] = line[cut + 1 :].strip()
    return out


def strip_prefix(values: dict[str, str], prefix: str) -> dict[str, str]:
    return {k.removeprefix(prefix): v for k, v in values.items() if k.startswith(prefix)}
