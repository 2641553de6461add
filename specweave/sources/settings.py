"""Settings that change results: defaults, then a YAML file, then the environment, then arguments."""

from __future__ import annotations

import dataclasses
import os
from typing import Any

import yaml


@dataclasses.dataclass(frozen=True)
class Settings:
    task: str = "gen_plan"
    design_name: str = ""
    use_kg: bool = True
    chunk_sizes: tuple[int, ...] = (50, 100, 200, 800, 3200)
    overlap_ratios: tuple[float, ...] = (0.2, 0.4)
    per_retriever: int = 20
    enable_rtl: bool = True
    whole_text: bool = False
    max_path_depth: int = 5
    path_style: str = "standard"
    expansion_depth: int = 2
    expansion_size: int = 20
    walks: int = 70
    walk_budget: int = 100
    teleport: float = 0.1
    alpha: float = 0.3
    beta: float = 0.5
    gamma: float = 0.2
    walk_targets: int = 10
    walk_contexts: int = 50
    prune: bool = True
    max_contexts: int = 100
    max_tokens_per_prompt: int = 8000
    prompts_per_signal: int = 3
    max_signals: int | None = None
    generators: tuple[str, ...] = ("rag", "path")

    def replaced(self, values: dict[str, Any]) -> Settings:
        kinds = {f.name: f for f in dataclasses.fields(self)}
        if unknown := sorted(set(values) - set(kinds)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        fit = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        return dataclasses.replace(self, **fit)


#: Environment variables that are read, and what they set.
ENVIRONMENT = {"SPECWEAVE_TASK": "task", "SPECWEAVE_DESIGN": "design_name", "SPECWEAVE_USE_KG": "use_kg"}


def load(path: str | None = None, arguments: dict[str, Any] | None = None, environment: dict[str, str] | None = None) -> Settings:
    out = Settings()
    if path:
        with open(path, encoding="utf-8") as f:
            out = out.replaced(yaml.safe_load(f) or {})
    env = os.environ if environment is None else environment
    found = {name: env[key] for key, name in ENVIRONMENT.items() if key in env}
    if "use_kg" in found:
        found["use_kg"] = found["use_kg"].lower() in ("1", "true", "yes")
    return out.replaced(found).replaced(arguments or {})
