"""Paths: extensions, types, names, roots."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PLAIN_TEXT_NAMES, SUPPORTED_EXTENSIONS

PLAIN_TEXT, PDF = "PlainText", "Pdf"

#: Extension -> language of an editor.
LANGUAGES = {
    "rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "json": "json",
    "jsonl": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html",
    "css": "css", "scss": "css", "sass": "css", "xml": "xml", "sql": "sql", "sh": "shell", "bash": "shell", "zsh": "shell", "go": "go",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "rb": "ruby", "swift": "swift", "kt": "kotlin",
    "cs": "csharp",
}
#: Extension (in this case only) -> MIME type.
MIME_TYPES = {
    "pdf": "application/pdf", "txt": "text/plain", "md": "text/plain", "rst": "text/plain", "html": "text/html", "htm": "text/html",
    "json": "application/json", "xml": "application/xml", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
}


def name_of(path: Column) -> Column:
    """What follows the last separator, of either kind."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def directory_of(path: Column) -> Column:
    """What precedes the last separator, with forward slashes."""
    return F.translate(F.regexp_extract(path, r"^(?s)(.*)[/\\][^/\\]*$", 1), "\\", "/")


def extension_of(path: Column) -> Column:
    """What follows the name's last dot; "" if there is none or the name begins with it."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def file_type(path: Column, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> Column:
    """PlainText, Pdf, or null for what is not searched."""
    ext = F.lower(extension_of(path))
    allowed = [e.lower() for e in extensions]
    known = F.lower(F.regexp_extract(path, r"([^/]*)$", 1)).isin(*PLAIN_TEXT_NAMES)
    return F.when(ext.isin(*allowed), F.when(ext == "pdf", PDF).otherwise(PLAIN_TEXT)).when(known, PLAIN_TEXT)


def language_hint(path: Column) -> Column:
    return _lookup(LANGUAGES, F.lower(extension_of(path)))


def mime_type(path: Column) -> Column:
    return F.coalesce(_lookup(MIME_TYPES, extension_of(path)), F.lit("application/octet-stream"))


def omit_reason(path: Column, size: Column, max_size: int, extensions: tuple[str, ...] | list[str] = SUPPORTED_EXTENSIONS) -> Column:
    """Why a listing leaves a file out: an unsupported extension counts before a size. Null: it is listed."""
    too_large = (size > max_size) if max_size > 0 else F.lit(False)
    return F.when(file_type(path, extensions).isNull(), "UnsupportedExtension").when(too_large, "TooLarge")


def sanitized(path: Column) -> Column:
    """A relative path without empty parts, "." and ".."."""
    return F.array_join(F.filter(F.split(path, r"[/\\]"), lambda p: ~p.isin("", ".", "..")), "/")


def relative(path: Column, root: str) -> Column:
    """path below root; others stay."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def absolute(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def contains_ignoring_case(path: Column, wanted: str) -> Column:
    return F.contains(F.lower(path), F.lit(wanted.lower()))


def normalized(path: str) -> str:
    """path with "." and ".." resolved by name alone."""
    return posixpath.normpath(path) if path else path


def is_under(path: str, root: str) -> bool:
    """Whether path is root or below it, part by part."""
    a, b = normalized(path).rstrip("/"), normalized(root).rstrip("/")
    return a == b or a.startswith(b + "/")
