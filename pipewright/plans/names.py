"""Names of result columns."""

from __future__ import annotations

import os
import re


def flat(parts: tuple[str, ...]) -> str:
    return "_".join(parts)


def unique(name: str, taken) -> str:
    """``name``, or with the first free number from 2 on."""
    taken = set(taken)
    n, out = 2, name
    while out in taken:
        out, n = f"{name}_{n}", n + 1
    return out


def has_glob(path: str) -> bool:
    return any(c in path for c in "*?{")


def side_name(path: str) -> str:
    """What a joined file's clashing columns are prefixed with: its base name in snake case, without extension or pattern
    marks; of a bare pattern the next directory's name; ``right`` if nothing is left."""
    glob = has_glob(path)
    while path and path != os.sep:
        base, path = os.path.basename(path.rstrip("/")), os.path.dirname(path.rstrip("/"))
        stem = base[: base.rfind(".")] if "." in base else base
        if glob:
            stem = re.sub(r"[*?{}\[\]\\]", "", stem).strip("_")
        out, lower = [], False
        for c in stem:
            if c.isalpha() or c.isdecimal():
                out.append("_" * (c.isupper() and lower) + c.lower())
                lower = c.islower() or c.isdecimal()
            else:
                out.append("_")
                lower = False
        if name := "".join(out).strip("_"):
            return name
    return "right"
