"""Settings: defaults, then the nearest TOML file, then the environment, then explicit values."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

FILE, PREFIX = "deltaloom.toml", "DELTALOOM_"


@dataclass(frozen=True)
class Config:
    model: str = ""
    host: str = "http://localhost:11434"
    timeout: int = 600
    num_ctx: int = 16384
    workers: int = 2
    fail_on: str = "high"
    min_confidence: float = 0.45
    max_callers: int = 8
    snippet_radius: int = 3
    include_tests: bool = True
    max_unit_tokens: int = 0
    max_symbol_lines: int = 400
    verify: bool = True
    co_change: bool = True
    two_hop: bool = True
    exclude: tuple[str, ...] = ("node_modules", "venv", "build", "dist", "site-packages", "__pycache__")
    roots: tuple[str, ...] = ()
    use_cache: bool = True
    source: str | None = None

    @property
    def unit_budget(self) -> int:
        """Tokens of a packet: what is set, else 65 % of the model's context, 1200 at least."""
        return self.max_unit_tokens or max(1200, int(self.num_ctx * 0.65))


def _typed(name: str, value: object) -> object:
    default = getattr(Config, name)
    if isinstance(default, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(default, tuple):
        return tuple(value.split(",") if isinstance(value, str) else value)
    return type(default)(value) if default is not None else value


def load(start: Path, env: dict[str, str] | None = None, **flags: object) -> Config:
    """The settings that hold in a directory; unknown names are ignored, flags that are None too."""
    names = {f.name for f in fields(Config)} - {"source"}
    out, found = {}, next((p for d in (start.resolve(), *start.resolve().parents) if (p := d / FILE).is_file()), None)
    if found:
        table = tomllib.loads(found.read_text(encoding="utf-8"))
        flat = {k: v for k, v in table.items() if not isinstance(v, dict)} | {k: v for part in table.values() if isinstance(part, dict) for k, v in part.items()}
        out |= {k: v for k, v in flat.items() if k in names} | {"source": str(found)}
    env = os.environ if env is None else env
    out |= {n: env[PREFIX + n.upper()] for n in names if PREFIX + n.upper() in env}
    out |= {k: v for k, v in flags.items() if k in names and v is not None}
    return replace(Config(), **{k: v if k == "source" else _typed(k, v) for k, v in out.items()})


TEMPLATE = "\n".join(["# Settings of deltaloom; all are optional.", *(f"# {f.name} = {str(f.default).lower() if isinstance(f.default, bool) else list(f.default) if isinstance(f.default, tuple) else repr(f.default)}" for f in fields(Config) if f.name != "source"), ""])
