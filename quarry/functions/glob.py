"""Shell patterns, compiled at plan time to anchored regular expressions that Spark and DuckDB share."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.scalars import base_name, expand_env

# Patterns that are skipped by default, by platform.
UNIX_IGNORES = ["/dev/*", "/proc/*", "/selinux/*", "/sys/*", "/tmp/*", "lost+found/"]
MAC_IGNORES = [
    "$TMPDIR", ".Spotlight-V*", "/.Trashes/", "/cores/", "/Library/Caches/", "/Library/Logs/", "/net/", "/Network/", "/private/tmp/",
    "/private/var/folders/", "/private/var/log/", "/private/var/vm/", "/System/", "/Users/*/.Trash/", "/Users/*/Library/Caches/",
    "/Users/*/Library/Calendars/Calendar Cache/", "/Users/*/Library/Logs/", "/Volumes/",
]
WINDOWS_IGNORES = [
    "$TMP", "$TEMP", "Thumbs.db", "$$RECYCLE.BIN\\", "System Volume Information\\", "*\\pagefile.sys", "*\\swapfile.sys", "*\\hiberfil.sys",
    "*\\Windows.old\\", "*\\Windows\\Temp\\", "*\\$$Windows.*", "$USERPROFILE\\Local Settings\\Temporary Internet Files\\",
]


def default_ignores(platform: str, store_path: str | None = None) -> list[str]:
    """The patterns skipped by default on ``linux``, ``darwin`` or ``win32`` (names as in sys.platform; others as linux).

    With ``store_path``, the client's own cache files in it are skipped too.
    """
    sep = separator_of(platform)
    own = [] if store_path is None else [store_path.rstrip(sep) + sep + "*.cache*"]
    if sep == "\\":
        return [*WINDOWS_IGNORES, *own]
    return [*(MAC_IGNORES if platform == "darwin" else []), *UNIX_IGNORES, *own]


def separator_of(platform: str) -> str:
    return "\\" if platform.startswith("win") else "/"


def glob_regex(pattern: str, separator: str = "/") -> str:
    """* and ? within a path segment, [a-z] and [^a-z] classes, backslash escapes; anchored.

    Where the separator is a backslash, as on Windows, nothing can be escaped.  Raises ValueError for an
    unfinished class or escape.
    """
    out, i, escapes = [], 0, separator != "\\"
    other = f"[^{re.escape(separator)}]"
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(other + "*")
        elif c == "?":
            out.append(other)
        elif c == "\\" and escapes:
            if i == len(pattern):
                raise ValueError(f"unfinished escape in {pattern!r}")
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            body, first = "", True
            negate = pattern[i : i + 1] == "^"
            i += negate
            while first or pattern[i : i + 1] != "]":
                first = False
                if escapes and i < len(pattern) and pattern[i] == "\\":
                    i += 1
                if i >= len(pattern):
                    raise ValueError(f"unfinished class in {pattern!r}")
                body += pattern[i] if pattern[i] == "-" else re.escape(pattern[i])
                i += 1
            i += 1
            out.append(f"[{'^' if negate else ''}{body}]")
        else:
            out.append(re.escape(c))
    return "^(?s:" + "".join(out) + ")$"


@dataclass(frozen=True)
class Ignore:
    """One compiled pattern: a trailing separator means directories only, an inner one the full path."""

    pattern: str
    regex: str
    full_path: bool
    only_dirs: bool


def compile_ignores(patterns: list[str], env: dict[str, str] | None = None, separator: str = "/") -> list[Ignore]:
    """Patterns with their variables replaced; those that come out empty are left out."""
    out = []
    for pattern in patterns:
        match = expand_env(pattern, env or {})
        if not match:
            continue
        only_dirs = match.endswith(separator)
        match = match[:-1] if only_dirs else match
        out.append(Ignore(pattern, glob_regex(match, separator), separator in match, only_dirs))
    return out


def ignored_by(path: Column, is_dir: Column, ignores: list[Ignore], separator: str = "/") -> Column:
    """The first pattern that matches, or null."""
    found = []
    base = base_name(path) if separator == "/" else F.substring_index(path, separator, -1)
    for g in ignores:
        hit = (path if g.full_path else base).rlike(g.regex)
        found.append(F.when((hit & is_dir) if g.only_dirs else hit, F.lit(g.pattern)))
    return F.coalesce(*found, F.lit(None).cast("string"))
