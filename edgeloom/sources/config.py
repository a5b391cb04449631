"""Settings of a scan: sources with their roots, globs, filters and rewrites, from YAML or a mapping."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

# File endings by language, and what is read if nothing else is said.
LANGUAGES = {".py": "python", ".sql": "sql", ".hql": "sql", ".ddl": "sql", ".ipynb": "notebook", ".txt": "text", ".md": "text"}
INCLUDE = ["**/*.py", "**/*.sql", "**/*.ipynb", "**/*.txt"]
MAX_BYTES = 2_000_000
VERSION = "1"
LISTS = ("roots", "include", "exclude", "include_files", "exclude_files", "include_tables", "exclude_tables")


class ConfigError(ValueError):
    pass


@dataclass
class Source:
    name: str
    roots: list[str]
    include: list[str] = field(default_factory=lambda: list(INCLUDE))
    exclude: list[str] = field(default_factory=list)
    include_files: list[str] = field(default_factory=list)
    exclude_files: list[str] = field(default_factory=list)
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    rewrites: list[tuple[str, str]] = field(default_factory=list)
    default_schema: str | None = None
    default_catalog: str | None = None
    max_file_bytes: int = MAX_BYTES
    follow_symlinks: bool = False

    @property
    def settings(self) -> dict:
        """What the extractor needs to name tables."""
        return {"default_schema": self.default_schema, "default_catalog": self.default_catalog, "rewrites": self.rewrites, "include": self.include_tables, "exclude": self.exclude_tables}

    @property
    def digest(self) -> str:
        """Sixteen digits that change with the settings and with this program's version."""
        return hashlib.sha256(json.dumps([VERSION, asdict(self)], sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Config:
    store: str
    sources: list[Source]

    @classmethod
    def load(cls, path: str) -> Config:
        import yaml

        try:
            raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        except yaml.YAMLError as error:
            raise ConfigError(f"{path}: {error}") from error
        return cls.from_dict(raw, Path(path).resolve().parent)

    @classmethod
    def from_dict(cls, raw: dict, base: Path | str = ".") -> Config:
        if not isinstance(raw, dict):
            raise ConfigError("a config is a mapping")
        defaults, base = raw.get("defaults") or {}, Path(base)
        entries = raw.get("sources")
        if not isinstance(entries, list) or not entries:
            raise ConfigError("sources: a list with at least one source is needed")
        sources = [cls._source(e, defaults, base) for e in entries]
        names = [s.name for s in sources]
        if len(set(names)) < len(names):
            raise ConfigError("sources: names must differ")
        store = raw.get("store") or raw.get("database") or "joins"
        return cls(store if "://" in str(store) else str(base / store), sources)

    @staticmethod
    def _source(entry: dict, defaults: dict, base: Path) -> Source:
        if not isinstance(entry, dict):
            raise ConfigError("a source is a mapping")
        both = {**defaults, **entry}
        known = {f for f in Source.__dataclass_fields__}
        if unknown := set(both) - known:
            raise ConfigError(f"unknown settings: {', '.join(sorted(unknown))}")
        name = both.get("name")
        if not isinstance(name, str) or not name.strip():
            raise ConfigError("a source needs a name")
        for k in LISTS:
            if isinstance(both.get(k), str):
                both[k] = [both[k]]
            if k in both and not (isinstance(both[k], list) and all(isinstance(x, str) for x in both[k])):
                raise ConfigError(f"{name}: {k} is a list of texts")
        if not both.get("roots"):
            raise ConfigError(f"{name}: roots are needed")
        both["roots"] = [r if "://" in r else str((base / r).resolve()) for r in both["roots"]]
        rules = both.get("rewrites") or []
        both["rewrites"] = [(r["from"], r["to"]) if isinstance(r, dict) else tuple(r) for r in rules]
        size = both.get("max_file_bytes", MAX_BYTES)
        if not isinstance(size, int) or isinstance(size, bool) or size <= 0:
            raise ConfigError(f"{name}: max_file_bytes is a positive number")
        for p in [x for k in LISTS[3:] for x in both.get(k, [])] + [p for p, _ in both["rewrites"]]:
            try:
                re.compile(p)
            except re.error as error:
                raise ConfigError(f"{name}: {p!r} is no regular expression: {error}") from error
        return Source(**both)

    def select(self, names: list[str] | None) -> list[Source]:
        """The named sources, all if none is named; KeyError for an unknown name."""
        if not names:
            return self.sources
        by_name = {s.name: s for s in self.sources}
        if missing := [n for n in names if n not in by_name]:
            raise KeyError(f"no such source: {', '.join(missing)}")
        return [by_name[n] for n in names]
