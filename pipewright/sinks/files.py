"""Output files: where they go, splitting, and putting all of them in place or none. Here the driver writes, row by row; see
``distributed`` for files that executors write."""

from __future__ import annotations

import glob
import itertools
import os
import re
import tempfile
from collections.abc import Iterable

from ..errors import WriteError
from ..lang.ast import Output
from ..types import Schema
from .writers import EXTENSION, WRITERS


def target(output: Output) -> str:
    """The path, with ``{n}`` where parts are numbered. A path that ends in a slash is a directory for ``output.ext``; a path
    without extension gets the format's, one with another's is an error."""
    extension = EXTENSION[output.format]
    path = output.path
    if path.endswith(("/", os.sep)):
        path = os.path.join(path, f"output-{{n}}.{extension}" if output.split_rows else f"output.{extension}")
    stem, own = os.path.splitext(path)
    if not own:
        path = f"{path}.{extension}"
    elif own[1:].lower() != extension:
        raise WriteError(f"{path} does not end in .{extension}")
    return path


def parts_pattern(path: str) -> re.Pattern:
    return re.compile("([1-9][0-9]*)".join(map(re.escape, path.split("{n}"))) + r"\Z")


def existing_parts(path: str) -> list[str]:
    """Files of an earlier run: the path with one number in place of each ``{n}``."""
    fits = parts_pattern(path)
    found = glob.glob("*".join(map(glob.escape, path.split("{n}"))))
    return [f for f in found if (m := fits.match(f)) and len(set(m.groups())) == 1]


def write_files(rows: Iterable, schema: Schema, output: Output, base: str | None = None) -> list[str]:
    """Write to staged files beside the target, then put them in place; on failure what was there stays."""
    path = target(output)
    path = path if os.path.isabs(path) else os.path.join(base or os.getcwd(), path)
    folder = os.path.dirname(path.split("{n}")[0]) if output.split_rows else os.path.dirname(path)
    os.makedirs(folder, exist_ok=True)
    old = existing_parts(path) if output.split_rows else [path] if os.path.lexists(path) else []
    if old and not output.overwrite:
        raise WriteError(f"{old[0]} exists; use 'with overwrite=true'")
    if bad := next((f for f in old if os.path.isdir(f)), None):
        raise WriteError(f"{bad} is a directory")
    staged: list[tuple[str, str]] = []
    rows = iter(rows)
    with tempfile.TemporaryDirectory(prefix=".staged-", dir=folder) as stage:
        for n in itertools.count(1):
            part = rows
            if output.split_rows:
                first = list(itertools.islice(rows, 1))
                if not first and n > 1:
                    break
                part = itertools.chain(first, itertools.islice(rows, output.split_rows - 1))
            temporary = os.path.join(stage, f"part-{n}")
            with open(temporary, "wb") as out:
                WRITERS[output.format](part, schema, out)
                out.flush()
                os.fsync(out.fileno())
            staged.append((temporary, path.replace("{n}", str(n)) if output.split_rows else path))
            if not output.split_rows:
                break
        put_in_place(staged, old, stage, output.overwrite)
    return [final for _, final in staged]


def put_in_place(staged: list[tuple[str, str]], old: list[str], stage: str, overwrite: bool) -> None:
    saved: list[tuple[str, str]] = []
    done: list[str] = []
    try:
        for i, f in enumerate(old):
            keep = os.path.join(stage, f"old-{i}")
            os.rename(f, keep)
            saved.append((keep, f))
        for temporary, final in staged:
            os.makedirs(os.path.dirname(final), exist_ok=True)
            os.link(temporary, final)  # fails if someone else made the file meanwhile
            done.append(final)
    except OSError as e:
        for f in done:
            os.unlink(f)
        for keep, f in saved:
            os.rename(keep, f)
        raise WriteError(f"cannot write {e.filename2 or e.filename}: {e.strerror}") from None
