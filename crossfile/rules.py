"""What a project says about itself: doors, kept names, sinks, layers, bans and skips."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

#: The table of the rules in pyproject.toml and package.json.
SECTION = "crossfile"
#: Folders that are never the package itself. Fixed values.
ASIDE = frozenset({"tests", "test", "docs", "scripts", "examples", "node_modules"})


@dataclass(frozen=True)
class Skip:
    """Findings in files under ``path`` (a glob), of the named checks or of all, are excused because of ``why``."""

    path: str
    why: str
    checks: tuple[str, ...] = ()


@dataclass(frozen=True)
class Project:
    package_dir: Path | None = None
    language: str = "python"
    entries: frozenset[str] = frozenset()
    keep: frozenset[str] | DataFrame = frozenset()  # a table (name), where they are too many for the driver
    library: bool = False
    sinks: frozenset[str] = frozenset()
    layers: tuple[str, ...] = ()
    forbid: dict[str, tuple[str, ...]] = field(default_factory=dict)
    skips: tuple[Skip, ...] = ()


def _strings(value: object) -> list[str]:
    return [str(v) for v in value] if isinstance(value, list) else []


def skips_of(given: object) -> tuple[Skip, ...]:
    rows = given if isinstance(given, list) else []
    for s in rows:
        if not isinstance(s, dict) or not s.get("path") or not s.get("why"):
            raise ValueError(f"a skip needs a path and a why: {s}")
    return tuple(Skip(str(s["path"]), str(s["why"]), tuple(_strings(s.get("checks")))) for s in rows)


def _project(rules: object, package: Path, language: str, scripts: frozenset[str] = frozenset()) -> Project:
    rules = rules if isinstance(rules, dict) else {}
    names = lambda key: frozenset(_strings(rules.get(key)))
    bans = rules.get("forbid")
    return Project(
        package, language, names("entries") | scripts, names("keep"), rules.get("library") is True, names("sinks"),
        tuple(_strings(rules.get("layers"))), {str(k): tuple(_strings(v)) for k, v in bans.items()} if isinstance(bans, dict) else {}, skips_of(rules.get("skip")),
    )


def _above(start: Path, name: str) -> Path | None:
    start = start.resolve()
    return next((d / name for d in (start, *start.parents) if (d / name).is_file()), None)


def declares_rules(given: Path) -> bool:
    """Whether the nearest project file has the section, even an empty one."""
    tool = _read(_above(given, "pyproject.toml"), tomllib.loads).get("tool", {})
    return SECTION in tool or SECTION in _read(_above(given, "package.json"), json.loads)


def is_typescript(folder: Path) -> bool:
    """No Python package, TypeScript in it, and a tsconfig.json beside it or above."""
    return not (folder / "__init__.py").exists() and _above(folder, "tsconfig.json") is not None and next(folder.rglob("*.ts"), None) is not None


def find_package(root: Path) -> Path:
    """The one package below a project's folder."""
    if (root / "__init__.py").is_file():
        return root
    if (root / "tsconfig.json").is_file() and (root / "src").is_dir() and next(root.glob("*/__init__.py"), None) is None:
        return root / "src"
    found = [p.parent for pattern in ("*/__init__.py", "src/*/__init__.py") for p in sorted(root.glob(pattern)) if p.parent.name not in ASIDE and not p.parent.name.startswith(".")]
    if len(found) != 1:
        raise ValueError(f"say which package to read in {root}: {', '.join(sorted(d.name for d in found)) or 'none found'}")
    return found[0]


def _read(at: Path | None, parse) -> dict:
    try:
        found = parse(at.read_text(encoding="utf-8")) if at else {}
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def project_for(given: Path | None = None) -> Project:
    """The project of a package, or of the one package in a folder: by default the current one. A malformed rule file counts as none."""
    given = (given or Path.cwd()).resolve()
    package = given if is_typescript(given) and not (given / "tsconfig.json").is_file() else find_package(given)
    if is_typescript(package):
        return _project(_read(_above(package, "package.json"), json.loads).get(SECTION), package, "typescript")
    data = _read(_above(package, "pyproject.toml"), tomllib.loads)
    scripts = data.get("project", {}).get("scripts", {})
    doors = frozenset(str(v).rpartition(":")[2] for v in scripts.values() if ":" in str(v))
    return _project(data.get("tool", {}).get(SECTION), package, "python", doors)


def package_of_file(file: Path) -> Path | None:
    """The package a file is in: the topmost folder above it with an __init__.py, or a TypeScript project's src/."""
    above = file.resolve().parents
    if file.suffix != ".py":
        root = next((d for d in above if (d / "tsconfig.json").is_file() and (d / "package.json").is_file()), None)
        return root / "src" if root and root / "src" in above else None
    top = None
    for d in above:
        if not (d / "__init__.py").is_file():
            break
        top = d
    return None if top is None or top.name in ASIDE else top
