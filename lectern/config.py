"""Run settings: a YAML file over defaults, dotted overrides, rules, and a frozen copy."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

from lectern.functions.text import LEXICAL_PARTICLES

REQUIRED = object()

# The names that settings files use, and their defaults.
DEFAULTS: dict = {
    "run_id": REQUIRED,
    "base_model": REQUIRED,
    "seed": 42,
    "data": {"dataset_path": REQUIRED, "ood_eval_path": None, "real_bench_path": None, "real_clip_path": None, "val_meetings": []},
    "normalization": {"strip_punctuation": True, "lowercase": True, "number_convention": "word_to_digit", "audit_conversions": True, "filler_tokens": []},
    "eval": {"split": "test", "limit": None, "batch_size": 8, "num_beams": 1, "language": "vi"},
    "lora": {"rank": 16, "alpha": 32, "target_modules": ["q_proj", "k_proj", "v_proj", "out_proj", "fc1", "fc2"], "dropout": 0.05, "use_rslora": True, "min_retained_energy": 0.99},
    "training": {"learning_rate": 2.0e-4, "epochs": 3, "batch_size": 8, "grad_accum_steps": 2, "warmup_ratio": 0.1, "full_finetune": False, "gradient_checkpointing": True, "limit": None},
    "sweep": {"lambdas": [0.0, 0.25, 0.5, 0.75, 1.0], "ood_cer_budget": 0.02, "elbow_ratio_threshold": 10.0},
    "gates": {"min_improvement_pct": 10.0, "real_cer_regression_pp": 0.0, "max_retention_regression_pp": 0.0},
    "hub": {"push": False, "repo_id": None, "private": True},
}


class SettingsError(ValueError):
    """A settings file breaks a rule."""


def merged(given: dict, defaults: dict, where: str = "settings") -> dict:
    """defaults with what is given on top; a key that no default has is an error, and so is a required one left out."""
    if unknown := sorted(set(given) - set(defaults)):
        raise SettingsError(f"{where}: unknown keys {unknown}")
    out = {}
    for key, default in defaults.items():
        if isinstance(default, dict):
            out[key] = merged(given.get(key) or {}, default, f"{where}.{key}")
        elif key not in given and default is REQUIRED:
            raise SettingsError(f"{where}.{key} is missing")
        else:
            out[key] = given.get(key, copy.copy(default))
    return out


def override(given: dict, expression: str) -> None:
    """Set a.b=value in place, the value read as YAML; the path has to be in the file."""
    import yaml

    path, equals, value = expression.partition("=")
    *parents, last = path.split(".")
    at = given
    for name in parents:
        at = at.get(name) if isinstance(at, dict) else None
    if not equals or not isinstance(at, dict) or last not in at:
        raise SettingsError(f"no such setting to override: {expression!r}")
    at[last] = yaml.safe_load(value)


def _number(x) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _apart(a: str, b: str | None) -> bool:
    """Neither path lies in the other."""
    if not b:
        return True
    x, y = Path(a).resolve(), Path(b).resolve()
    return not (x.is_relative_to(y) or y.is_relative_to(x))


#: What is wrong if the rule doesn't hold.
RULES: tuple[tuple[str, Callable[[dict], bool]], ...] = (
    ("normalization.filler_tokens holds lexical particles", lambda c: not {t.lower() for t in c["normalization"]["filler_tokens"]} & set(LEXICAL_PARTICLES)),
    ("lora.rank and lora.alpha have to be positive", lambda c: c["lora"]["rank"] > 0 and c["lora"]["alpha"] > 0),
    ("eval.limit has to be positive or null", lambda c: c["eval"]["limit"] is None or c["eval"]["limit"] > 0),
    ("training.limit has to be positive or null", lambda c: c["training"]["limit"] is None or c["training"]["limit"] > 0),
    ("training.learning_rate is no number; YAML reads 5.0e-05, but 5e-05 as text", lambda c: _number(c["training"]["learning_rate"])),
    ("lora.min_retained_energy has to lie in (0, 1]", lambda c: 0 < c["lora"]["min_retained_energy"] <= 1),
    ("sweep.lambdas is empty", lambda c: bool(c["sweep"]["lambdas"])),
    ("data.ood_eval_path is unset, so nothing can be selected", lambda c: bool(c["data"]["ood_eval_path"])),
    ("data.real_bench_path overlaps data.dataset_path", lambda c: _apart(c["data"]["dataset_path"], c["data"]["real_bench_path"])),
    ("data.real_clip_path overlaps data.dataset_path", lambda c: _apart(c["data"]["dataset_path"], c["data"]["real_clip_path"])),
    ("hub.push without hub.repo_id", lambda c: not c["hub"]["push"] or bool(c["hub"]["repo_id"])),
)


def validate(settings: dict) -> None:
    if broken := [message for message, holds in RULES if not holds(settings)]:
        raise SettingsError("; ".join(broken))


def load(path: str | Path, overrides: tuple[str, ...] = ()) -> dict:
    import yaml

    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    for expression in overrides:
        override(given, expression)
    settings = merged(given, DEFAULTS)
    validate(settings)
    return settings


def view(settings: dict) -> SimpleNamespace:
    """The same settings with attribute access."""
    return SimpleNamespace(**{k: view(v) if isinstance(v, dict) else v for k, v in settings.items()})


def freeze(settings: dict, path: str | Path) -> Path:
    """Write the resolved settings, which later stages read in place of the YAML."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(settings, indent=2, ensure_ascii=False), encoding="utf-8")
    return path


def record_stage(path: str | Path, stage: str, **facts) -> dict:
    """Add a finished stage to a state file, keeping the others."""
    path = Path(path)
    state = json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
    state[stage] = facts
    path.write_text(json.dumps(state, indent=2, ensure_ascii=False), encoding="utf-8")
    return state


def yaml_float(value: float) -> str:
    """A float as text that YAML reads back as one: it needs a point before an exponent."""
    text = repr(float(value))
    mantissa, e, exponent = text.partition("e")
    return f"{mantissa}.0e{exponent}" if e and "." not in mantissa else text
