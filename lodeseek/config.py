"""Queries, settings and their defaults. Settings are JSON objects; unknown keys survive a merge."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

#: Files whose extension is listed are searched.
SUPPORTED_EXTENSIONS = ("txt", "md", "json", "xml", "html", "htm", "log", "csv", "jsonl", "pdf")
#: Names that count as plain text without a listed extension.
PLAIN_TEXT_NAMES = ("makefile", "dockerfile", "jenkinsfile", "procfile", "gemfile", "rakefile", "vagrantfile", "podfile", "brewfile")

GREP, SEMANTIC = "Grep", "Semantic"


@dataclass(frozen=True)
class SearchQuery:
    """max_results and max_file_size: 0 is no limit. context_lines has no effect on results."""

    pattern: str
    is_regex: bool = False
    case_sensitive: bool = False
    root: str | None = None
    max_results: int = 0
    respect_gitignore: bool = True
    max_file_size: int = 0
    context_lines: int = 2
    mode: str = GREP
    supported_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS


@dataclass(frozen=True)
class IndexingConfig:
    """Sizes in characters."""

    chunk_size: int = 600
    chunk_overlap: int = 128
    supported_extensions: tuple[str, ...] = SUPPORTED_EXTENSIONS

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError("overlap must be smaller than chunk size")


ENGINES = ("SBERT", "Candle", "Fastembed")
#: Fixed value.
DEFAULT_ENGINE = "Fastembed"
#: Fixed value.
DEFAULT_MODELS = {"SBERT": "intfloat/e5-small-v2", "Candle": "sentence-transformers/all-MiniLM-L6-v2", "Fastembed": "AllMiniLML6V2"}
#: Fixed value.
DEFAULT_DEVICES = {"SBERT": "auto", "Candle": "auto", "Fastembed": "cpu"}


@dataclass
class SemanticSettings:
    enabled: bool = False
    selected: dict[str, Any] = field(default_factory=lambda: {"engine": DEFAULT_ENGINE, "model": DEFAULT_MODELS[DEFAULT_ENGINE], "dimension": 384})
    engine_devices: dict[str, str] = field(default_factory=dict)
    index_path: str | None = None
    custom_models: list[dict[str, str]] = field(default_factory=list)
    chunk_size: int = 600
    chunk_overlap: int = 128
    worker_timeout_secs: int = 300

    def device_for(self, engine: str) -> str:
        return self.engine_devices.get(engine, DEFAULT_DEVICES[engine])


@dataclass
class Settings:
    bookmarked_dirs: list[str] = field(default_factory=list)
    recent_dirs: list[str] = field(default_factory=list)
    last_directory: str | None = None
    respect_gitignore: bool = True
    max_file_size: int = 10 * 1024 * 1024
    context_lines: int = 2
    theme: str = "System"
    search_prefer_semantic: bool = False
    semantic: SemanticSettings = field(default_factory=SemanticSettings)
    supported_extensions: list[str] = field(default_factory=lambda: list(SUPPORTED_EXTENSIONS))
    max_results: int = 50


def _semantic(value: dict[str, Any]) -> SemanticSettings:
    known = {k: v for k, v in value.items() if k in SemanticSettings.__dataclass_fields__}
    if "selected" not in value:  # the older shape has engine, model and dimension side by side
        engine = value.get("engine", DEFAULT_ENGINE)
        known["selected"] = {"engine": engine, "model": value.get("model", DEFAULT_MODELS[DEFAULT_ENGINE]), "dimension": value.get("dimension", 384)}
    models = known.get("custom_models", [])
    known["custom_models"] = [{"engine": "SBERT", "model_id": m} if isinstance(m, str) else m for m in models] if isinstance(models, list) else []
    return SemanticSettings(**known)


def load_settings(text: str | None) -> Settings:
    """Settings of a JSON text; None (no file) gives the defaults."""
    if text is None:
        return Settings()
    value = json.loads(text)
    known = {k: v for k, v in value.items() if k in Settings.__dataclass_fields__}
    if "semantic" in known:
        known["semantic"] = _semantic(known["semantic"])
    return Settings(**known)


def merge_settings(text: str | None, patch: dict[str, Any]) -> str:
    """JSON after a patch; a key of the patch replaces the whole value."""
    value = asdict(load_settings(text)) if text is None else json.loads(text)
    merged = json.dumps({**value, **patch}, indent=2)
    load_settings(merged)
    return merged


def remember_directory(recent: list[str], directory: str, keep: int = 10) -> list[str]:
    """A new directory goes to the end; the last ten stay."""
    return recent if directory in recent else [*recent, directory][-keep:]


#: Fixed value.
GREP_CAPABILITIES = {
    "supports_regex": True, "supports_case_sensitivity": True, "is_indexed": False, "requires_index": False,
    "supported_file_types": ["txt", "md", "rs", "py", "js", "ts", "json", "toml", "yaml"],
}
SEMANTIC_CAPABILITIES = {"supports_regex": False, "supports_case_sensitivity": False, "is_indexed": True, "requires_index": True, "supported_file_types": list(SUPPORTED_EXTENSIONS)}
