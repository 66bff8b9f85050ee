"""Ignore files (.gitignore and .ignore) as one predicate over relative paths.

Rules of a folder hold below it; a later rule wins over an earlier one, a deeper file's over a higher
one's, and nothing below an ignored folder comes back.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


#: (expression over a whole relative path, negated, folders only).
Rule = tuple[str, bool, bool]


def _glob(pattern: str) -> str:
    out, at = "", 0
    while at < len(pattern):
        if pattern.startswith("**/", at):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif pattern.startswith("/**", at) and at + 3 == len(pattern):
            out, at = out + "/.+", at + 3
        elif pattern[at] == "*":
            out, at = out + "[^/]*", at + 1
            while pattern[at : at + 1] == "*":
                at += 1
        elif pattern[at] == "?":
            out, at = out + "[^/]", at + 1
        elif pattern[at] == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            body = pattern[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        else:
            if pattern[at] == "\\" and at + 1 < len(pattern):
                at += 1
            out, at = out + re.escape(pattern[at]), at + 1
    return out


def parse(text: str, folder: str = "") -> list[Rule]:
    """The rules of an ignore file in folder."""
    rules = []
    base = re.escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for raw in text.split("\n"):
        line = raw.rstrip("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        only_folders = line.endswith("/")
        line = line.rstrip("/")
        if not line:
            continue
        anchored = "/" in line
        body = _glob(line.lstrip("/"))
        rules.append((base + ("" if anchored else "(?:[^/]+/)*") + body, negated, only_folders))
    return rules


def ignored(path: Column, rules: list[Rule]) -> Column:
    """Whether a file's relative path, or a folder on its way, is ignored. rules: of higher folders first.

    Ways that no rule fits, which is most, are told by one expression of all rules.
    """
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    depth = F.size(parts)
    # Each way to the file, the file itself last.
    ways = F.transform(F.sequence(F.lit(1), depth), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < depth).alias("folder")))

    def verdict(way: Column) -> Column:
        out = F.lit(False)
        for expression, negated, only_folders in rules:
            fits = F.regexp_like(way["p"], F.lit(f"^(?:{expression})$"))
            out = F.when(fits & way["folder"] if only_folders else fits, F.lit(not negated)).otherwise(out)
        return out

    any_rule = F.lit("^(?:" + "|".join(f"(?:{e})" for e, _, _ in rules) + ")$")
    return F.exists(F.filter(ways, lambda way: F.regexp_like(way["p"], any_rule)), verdict)
