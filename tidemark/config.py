"""Settings, strictly typed: arguments go before the environment, that before a file, that before defaults.

Settings are one flat table of dotted names; a file's sections are only the part
before the dot.  What this engine has no use for is still accepted and typed, so
that files written for the reference's sections stay valid.
"""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from typing import Any

Check = Callable[[Any], Any]


def _kind(wanted: type, *also: type, says: str) -> Check:
    def check(value: Any) -> Any:
        if isinstance(value, bool) != (wanted is bool) or not isinstance(value, (wanted, *also)):
            raise TypeError(says)
        return wanted(value)

    return check


text, flag = _kind(str, says="text"), _kind(bool, says="true or false")
whole, number = _kind(int, says="a whole number"), _kind(float, int, says="a number")


def one_of(*names: str) -> Check:
    def check(value: Any) -> str:
        if value not in names:
            raise ValueError("one of " + ", ".join(names))
        return value

    return check


def at_least(least: float, inner: Check, strict: bool = False) -> Check:
    def check(value: Any) -> Any:
        made = inner(value)
        if made < least or (strict and made == least):
            raise ValueError(f"{'more than' if strict else 'at least'} {least:g}")
        return made

    return check


def optional(inner: Check) -> Check:
    return lambda value: None if value is None else inner(value)


def many(inner: Check, some: bool = False) -> Check:
    def check(value: Any) -> tuple:
        if not isinstance(value, list | tuple) or (some and not value):
            raise TypeError("a list" + " that is not empty" * some)
        return tuple(inner(v) for v in value)

    return check


def table(inner: Check) -> Check:
    def check(value: Any) -> dict[str, Any]:
        if not isinstance(value, Mapping):
            raise TypeError("a table")
        return {str(k): inner(v) for k, v in value.items()}

    return check


#: The names and defaults that users' files rely on.
KNOWN: dict[str, tuple[Check, Any]] = {
    "project.name": (text, "tidemark"),
    "project.output_dir": (text, "runs"),
    "logging.level": (one_of("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "INFO"),
    "logging.json": (flag, False),
    "io.input": (optional(text), None),
    "io.format": (text, "auto"),
    "io.mapping": (optional(text), None),
    "io.output": (optional(text), None),
    "io.output_format": (one_of("csv", "tsv", "jsonl", "parquet"), "csv"),
    "io.strict": (flag, False),
    "io.on_duplicate": (one_of("keep_first", "error"), "keep_first"),
    "io.event_types": (many(text), ()),
    "io.unknown_event_policy": (one_of("preserve", "map_to_other", "reject"), "preserve"),
    "sessionization.strategy": (one_of("explicit", "idle_timeout", "composite"), "composite"),
    "sessionization.idle_timeout_s": (at_least(0, number, strict=True), 1800.0),
    "sessionization.tokenization": (one_of("event_type", "activity_id"), "event_type"),
    "analysis.ngram_order": (at_least(1, whole), 2),
    "generator.name": (text, "markov"),
    "generation.n_sessions": (at_least(1, whole), 100),
    "generation.seed": (optional(at_least(0, whole)), None),
    "generation.id_strategy": (one_of("remap", "preserve"), "remap"),
    "validation.metrics": (many(text), ()),
    "validation.thresholds": (table(number), {}),
    "visualization.formats": (many(one_of("png", "svg", "pdf"), some=True), ("png",)),
    "visualization.dpi": (at_least(1, whole), 150),
    "visualization.output_dir": (optional(text), None),
    "benchmark.protocol": (text, "session_fidelity_v1"),
    "benchmark.generators": (many(text, some=True), ("markov", "semi_markov")),
    "benchmark.repeats": (at_least(1, whole), 3),
    "privacy.strip_metadata_keys": (many(text), ()),
}
#: A generator's own settings have any name; each generator checks them.
OPEN = "generator"
#: The only variables that are read.
ENVIRONMENT = {"TIDEMARK_LOG_LEVEL": "logging.level", "TIDEMARK_OUTPUT_DIR": "project.output_dir", "TIDEMARK_SEED": "generation.seed"}


class Settings(Mapping[str, Any]):
    """All settings by dotted name; those not given have their defaults."""

    def __init__(self, given: Mapping[str, Any] | None = None):
        self._made = {k: default for k, (_, default) in KNOWN.items()}
        for key, value in (given or {}).items():
            if key not in KNOWN and key.partition(".")[0] != OPEN:
                raise ValueError(f"unknown setting {key}")
            try:
                self._made[key] = KNOWN[key][0](value) if key in KNOWN else value
            except (TypeError, ValueError) as e:
                raise ValueError(f"{key} takes {e}, not {value!r}") from None

    def __getitem__(self, key: str) -> Any:
        return self._made[key]

    def __iter__(self) -> Iterator[str]:
        return iter(self._made)

    def __len__(self) -> int:
        return len(self._made)

    def generator(self) -> dict[str, Any]:
        """The settings of the generator beside its name."""
        return {k.partition(".")[2]: v for k, v in self._made.items() if k.startswith(f"{OPEN}.") and k not in KNOWN}

    def sections(self) -> dict[str, dict[str, Any]]:
        """As a file has them."""
        out: dict[str, dict[str, Any]] = {}
        for key, value in self._made.items():
            section, _, name = key.partition(".")
            out.setdefault(section, {})[name] = value
        return out


def read_file(path: str) -> dict[str, Any]:
    """A TOML, YAML (where its library is there) or JSON file of the driver."""
    body, suffix = Path(path).read_text(encoding="utf-8"), Path(path).suffix
    if suffix == ".toml":
        return tomllib.loads(body)
    if suffix in (".yaml", ".yml"):
        import yaml  # an optional library

        return yaml.safe_load(body) or {}
    if suffix == ".json":
        return json.loads(body)
    raise ValueError(f"{path}: .toml, .yaml, .yml or .json")


def flat(sections: Mapping[str, Any]) -> dict[str, Any]:
    out = {}
    for section, values in sections.items():
        if not isinstance(values, Mapping | None):
            raise ValueError(f"{section} must be a section")
        out |= {f"{section}.{k}": v for k, v in (values or {}).items()}
    return out


def load(path: str | None = None, overrides: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> Settings:
    """Settings of a file, the environment and dotted overrides; unknown names are errors."""
    variables = {key: raw.strip() for name, key in ENVIRONMENT.items() if (raw := (os.environ if environ is None else environ).get(name, "")).strip()}
    numbers = {k: int(v) for k, v in variables.items() if k == "generation.seed"}
    return Settings(flat(read_file(path) if path else {}) | variables | numbers | dict(overrides or {}))
