"""Search patterns as Java regular expressions with the semantics of a linear-time, Unicode-aware engine.

Look-around, back-references, possessive and atomic groups are refused. Classes are Unicode-aware, "."
and line ends know "\\n" only, and "$" is the end of the text.
"""

from __future__ import annotations

import re


class PatternError(ValueError):
    pass


def escape(text: str) -> str:
    """text as a literal; a space stands for any white space."""
    return "".join(r"\s+" if c == " " else c if c.isalnum() or c == "_" or ord(c) > 127 else "\\x" + f"{ord(c):02x}" for c in text)


def _translated(pattern: str) -> str:
    out, at, in_class = [], 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            follower = pattern[at + 1 : at + 2]
            if not follower:
                raise PatternError("pattern ends with a backslash")
            if not in_class and (follower.isdigit() and follower != "0" or follower in "kGZ"):
                raise PatternError(f"not supported: \\{follower}")
            out.append(c + follower)
            at += 2
            continue
        if in_class:
            in_class += (c == "[") - (c == "]")
            out.append(c)
        elif c == "[":
            in_class = 1
            out.append(c)
            for extra in ("^", "]"):  # a bracket first in a class is an ordinary character
                if pattern[at + 1 : at + 2] == extra:
                    out.append(extra if extra == "^" else "\\]")
                    at += 1
        elif c == "(" and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), at):
            raise PatternError("look-around and atomic groups are not supported")
        elif pattern.startswith("(?P<", at):
            out.append("(?<")
            at += 3
        elif c == "$":
            out.append(r"\z")
        else:
            out.append(c)
            if c in "*+?}" and pattern[at + 1 : at + 2] == "+":
                raise PatternError("possessive quantifiers are not supported")
        at += 1
    return "".join(out)


def compile_pattern(pattern: str, is_regex: bool = False, case_sensitive: bool = False) -> str:
    """The Java expression. Raises PatternError if the pattern is not well-formed."""
    body = _translated(pattern) if is_regex else escape(pattern)
    try:
        re.compile(re.sub(r"\\z", r"\\Z", re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", re.sub(r"\\[pP](\{\^?\w+\}|\w)", "x", body))))
    except re.error as error:
        raise PatternError(str(error)) from error
    return f"(?{'dU' if case_sensitive else 'dUiu'}){body}"


def spans_lines(java: str) -> bool:
    """Whether a match in a line need not be one in the whole text: it has anchors."""
    return bool(re.search(r"\^|\\[AzZ]", re.sub(r"\\\\|\[\^", "", java)))


def may_be_empty(java: str) -> bool:
    """Whether the pattern can match nothing; True if in doubt."""
    body = re.sub(r"^\(\?[a-zA-Z]+\)", "", java)
    body = re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", re.sub(r"\\[pP](\{\^?\w+\}|\w)", "x", body)).replace("\\z", "\\Z")
    try:
        from re import _parser as parser

        return parser.parse(body).getwidth()[0] == 0
    except (re.error, AttributeError):
        return True
