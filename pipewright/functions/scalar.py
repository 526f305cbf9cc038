"""The scalar functions: how each is type-checked and which Column it is."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import PlanError
from ..types import BOOL, INT, STRING, LType, TypeConflict, contains, is_kind, unify
from .values import coerce, equal, same

# Unicode white space, which trim strips.
SPACE = r"[\t-\r \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Largest 32-bit position that Spark's substring takes.
FAR = 2**31 - 2


@dataclass(frozen=True)
class Function:
    """``check`` gives the result's type; ``build`` the Column from (column, type) of the arguments and their literal values."""

    arity: tuple[int, int | None]
    check: Callable[[list[LType]], LType]
    build: Callable[..., Column]


def needs(name: str, t: LType, kind: str) -> None:
    if not is_kind(t, kind):
        raise PlanError(f"{name}() needs {kind}, got {t}")


def nullable(out: LType, args: list[LType]) -> LType:
    return out.maybe(any(a.nullable for a in args))


def of_kinds(name: str, kinds: list[str], out: LType):
    def check(args: list[LType]) -> LType:
        for t, kind in zip(args, kinds, strict=True):
            needs(name, t, kind)
        return nullable(out, args)

    return check


def strings(name: str, n: int, out: LType, build) -> Function:
    return Function((n, n), of_kinds(name, ["string"] * n, out), lambda args, types, literals: build(*args))


def substring(args, types, literals) -> Column:
    s, start, length = args
    size = F.char_length(s).cast("long")
    at = F.when(start < 0, F.greatest(size + F.greatest(start, -size), F.lit(0).cast("long"))).otherwise(F.least(start, size))
    cut = F.substr(s, at.cast("int") + 1, F.least(length, F.lit(FAR)).cast("int"))
    bad = F.raise_error(F.concat(F.lit("substr(): negative length "), length.cast("string"))).cast("string")
    return F.when(s.isNotNull() & start.isNotNull() & length.isNotNull(), F.when(length < 0, bad).otherwise(cut))


def java_regex(pattern: str) -> str:
    """An RE2 pattern as Java reads it. What RE2 rejects is rejected: look-around and back-references."""
    if m := re.search(r"(?<!\\)(?:\\\\)*\((\?[=!]|\?<[=!]|\?>)", pattern):
        raise PlanError(f"matches(): invalid pattern: {m[1]!r} is not supported")
    out, at, inside, multi = [], 0, False, bool(re.match(r"\(\?[a-z]*m", pattern))
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            n = pattern[at + 1]
            if n.isdigit() and n != "0" and not inside:
                raise PlanError("matches(): invalid pattern: back-references are not supported")
            if n == "C" or n == "Z":
                raise PlanError(f"matches(): invalid pattern: \\{n} is not supported")
            out.append(c + n)
            at += 2
            continue
        if c == "[" and inside and not pattern.startswith("[:", at):
            out.append("\\[")
        elif c == "[" and not inside:
            inside = True
            out.append(c)
            if pattern.startswith("^", at + 1):
                out.append("^")
                at += 1
            if pattern.startswith("]", at + 1):
                out.append("\\]")
                at += 1
        elif pattern.startswith("[:", at) and inside and (end := pattern.find(":]", at)) > 0:
            name = pattern[at + 2 : end]
            out.append(("\\P{" if name.startswith("^") else "\\p{") + POSIX.get(name.lstrip("^"), name.lstrip("^")) + "}")
            at = end + 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        elif c == "&" and inside:
            out.append("\\&")
        elif c == "$" and not inside and not multi:
            out.append("\\z")
        elif pattern.startswith("(?P<", at):
            out.append("(?<")
            at += 3
        else:
            out.append(c)
        at += 1
    try:
        re.compile(re.sub(r"\\[pP](\{\^?\w+\}|\w)|\\z|\[\[?:|\(\?<|\\[QE]", "x", pattern) if "\\p" in pattern or "\\P" in pattern or "\\z" in pattern or "[[:" in pattern or "(?<" in pattern else pattern)
    except re.error as e:
        raise PlanError(f"matches(): invalid pattern {pattern!r}: {e}") from None
    return "(?d)" + "".join(out)


# Names of ASCII classes in RE2 and in Java.
POSIX = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit", "word": "IsWord"}


def matches(args, types, literals) -> Column:
    s, pattern = args
    if literals[1] is not None:
        return s.rlike(java_regex(literals[1]))
    # a pattern from a column can only be adapted, not checked, before it runs
    return F.regexp(s, F.concat(F.lit("(?d)"), F.regexp_replace(pattern, r"(?<!\\)\$$", r"\\z")))


ISO = r"^(\d{4})-(\d{2})-(\d{2})(?:T(\d{1,2}):(\d{2}):(\d{2})(?:[.,]\d+)?(?:Z|[+-]\d{2}:\d{2})?| (\d{1,2}):(\d{2}):(\d{2})(?:[.,]\d+)?)?\z"
US = r"^(\d{1,2})/(\d{1,2})/(\d{4})\z"
SLASHED = r"^(\d{4})/(\d{2})/(\d{2})\z"


def date_part(name: str) -> Function:
    """From a string in one of seven layouts (ISO date, with time after T or a space, with a zone after T; month first or year
    first with slashes); a string in none of them fails. The part is the value's own, whatever its zone. Timestamps and
    dates, an extension, are taken as they are."""

    def check(args: list[LType]) -> LType:
        if args[0].kind not in ("string", "null", "timestamp", "date"):
            raise PlanError(f"{name}() needs string, got {args[0]}")
        return nullable(INT, args)

    def build(args, types, literals) -> Column:
        s, part = args[0], {"year": F.year, "month": F.month, "day": F.dayofmonth}[name]
        if types[0].kind in ("timestamp", "date"):
            return part(s).cast("long")
        got = lambda pattern, i: F.regexp_extract(s, pattern, i)
        join = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
        text = (
            F.when(s.rlike(ISO), join(got(ISO, 1), got(ISO, 2), got(ISO, 3)))
            .when(s.rlike(US), join(got(US, 3), got(US, 1), got(US, 2)))
            .when(s.rlike(SLASHED), join(got(SLASHED, 1), got(SLASHED, 2), got(SLASHED, 3)))
        )
        clock = F.lit(True)
        for i, most in ((4, 24), (5, 60), (6, 60), (7, 24), (8, 60), (9, 60)):
            clock = clock & F.coalesce(F.nullif(got(ISO, i), F.lit("")).try_cast("int") < most, F.lit(True))
        day = F.when(clock, F.call_function("try_to_date", text, F.lit("yyyy-MM-dd")))
        bad = F.raise_error(F.concat(F.lit(f"{name}(): cannot read "), s, F.lit(" as a date"))).cast("long")
        return F.when(s.isNotNull(), F.coalesce(part(day).cast("long"), bad))

    return Function((1, 1), check, build)


def check_list_len(args: list[LType]) -> LType:
    needs("list_len", args[0], "list")
    return nullable(INT, args)


def check_list_contains(args: list[LType]) -> LType:
    xs, x = args
    needs("list_contains", xs, "list")
    if contains(xs, "union") or contains(x, "union"):
        raise PlanError("list_contains() cannot compare union values")
    if xs.kind == "list" and x.kind != "null" and xs.elem.kind not in ("mixed", "null"):
        try:
            unify(xs.elem, x)
        except TypeConflict:
            raise PlanError(f"list_contains() cannot look for {x} in {xs}") from None
    return nullable(BOOL, args)


def list_contains(args, types, literals) -> Column:
    xs, x = args
    t, u = types
    if t.kind == "null" or u.kind == "null":
        return F.lit(None).cast("boolean")
    if t.elem.kind == "mixed":
        def hit(e):
            if u.numeric:
                number = F.when(e.rlike(r"^-?\d"), e)
                as_int = F.when(number.rlike(r"^-?\d+$"), number.try_cast("long"))
                as_float = F.when(~number.rlike(r"^-?\d+$"), number.try_cast("double"))
                return F.coalesce(equal(as_int, INT, x, u), F.lit(False)) | F.coalesce(equal(as_float, LType("float"), x, u), F.lit(False))
            return F.coalesce(e == coerce(x, u, LType("mixed")), F.lit(False))
    elif t.elem.kind in ("list", "record"):
        def hit(e):
            return e.isNotNull() & same(e, t.elem, x, u)
    else:
        def hit(e):
            return F.coalesce(equal(e, t.elem, x, u), F.lit(False))
    return F.when(xs.isNotNull() & x.isNotNull(), F.exists(xs, hit))


def check_coalesce(args: list[LType]) -> LType:
    out = args[0]
    for t in args[1:]:
        try:
            out = unify(out, t)
        except TypeConflict:
            raise PlanError(f"coalesce() arguments differ: {out} and {t}") from None
    return LType(out.kind, all(a.nullable for a in args), out.fields, out.elem, out.branches)


def check_if(args: list[LType]) -> LType:
    needs("if", args[0], "bool")
    try:
        return unify(args[1], args[2])
    except TypeConflict:
        raise PlanError(f"if() branches differ: {args[1]} and {args[2]}") from None


def build_coalesce(args, types, literals) -> Column:
    out = check_coalesce(types)
    return F.coalesce(*[coerce(c, t, out) for c, t in zip(args, types, strict=True)])


def build_if(args, types, literals) -> Column:
    out = check_if(types)
    return F.when(args[0], coerce(args[1], types[1], out)).otherwise(coerce(args[2], types[2], out))


FUNCTIONS: dict[str, Function] = {
    "upper": strings("upper", 1, STRING, F.upper),
    "lower": strings("lower", 1, STRING, F.lower),
    "trim": strings("trim", 1, STRING, lambda s: F.regexp_replace(s, rf"^{SPACE}+|{SPACE}+\z", "")),
    "str_len": strings("str_len", 1, INT, lambda s: F.char_length(s).cast("long")),
    "substr": Function((3, 3), of_kinds("substr", ["string", "int", "int"], STRING), substring),
    "str_contains": strings("str_contains", 2, BOOL, lambda s, x: F.contains(s, x)),
    "starts_with": strings("starts_with", 2, BOOL, lambda s, x: F.startswith(s, x)),
    "ends_with": strings("ends_with", 2, BOOL, lambda s, x: F.endswith(s, x)),
    "matches": Function((2, 2), of_kinds("matches", ["string", "string"], BOOL), matches),
    "year": date_part("year"),
    "month": date_part("month"),
    "day": date_part("day"),
    "list_len": Function((1, 1), check_list_len, lambda args, types, literals: F.array_size(args[0]).cast("long") if types[0].kind != "null" else F.lit(None).cast("long")),
    "list_contains": Function((2, 2), check_list_contains, list_contains),
    "coalesce": Function((1, None), check_coalesce, build_coalesce),
    "if": Function((3, 3), check_if, build_if),
}
