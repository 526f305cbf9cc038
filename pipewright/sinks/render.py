"""Values as text: for tables and CSV, and as JSON."""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Callable
from decimal import Decimal
from json.encoder import encode_basestring

from ..errors import WriteError
from ..types import LType, Schema

ESCAPED = re.compile("[<>&\u2028\u2029]")


def decimal(x: float) -> tuple[str, str, int]:
    """Sign, shortest digits without zeros around them, and where the point stands among them."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    point = len(text) + exponent
    return "-" * sign, text.rstrip("0"), point


def plainly(sign: str, digits: str, point: int) -> str:
    if point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if point >= len(digits):
        return sign + digits + "0" * (point - len(digits))
    return f"{sign}{digits[:point]}.{digits[point:]}"


def scientifically(sign: str, digits: str, point: int, width: int) -> str:
    power = point - 1
    part = "." + digits[1:] if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{part}e{'-' if power < 0 else '+'}{abs(power):0{width}d}"


def float_text(x: float) -> str:
    """Shortest digits; with an exponent of two digits at least, below 1e-4 and from 1e6 on."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    if 1e-4 <= abs(x) < 1e6:  # here Python's shortest digits are plain too
        return repr(x).removesuffix(".0")
    sign, digits, point = decimal(x)
    if not digits:
        return sign + "0"
    return plainly(sign, digits, point) if -4 <= point - 1 < 6 else scientifically(sign, digits, point, 2)


def float_json(x: float) -> str:
    """Shortest digits; with an exponent below 1e-6 and from 1e21 on. JSON has no other numbers."""
    if not math.isfinite(x):
        raise WriteError(f"JSON cannot hold {float_text(x)}")
    if 1e-4 <= abs(x) < 1e16:
        return repr(x).removesuffix(".0")
    sign, digits, point = decimal(x)
    if not digits:
        return sign + "0"
    return plainly(sign, digits, point) if -6 <= point - 1 < 21 else scientifically(sign, digits, point, 1 if point < 1 else 2)


def member(value, t: LType):
    """The active value of a union, with its type."""
    return value[f"m{value['tag']}"], t.branches[value["tag"]]


def mixed(value: str):
    return json.loads(value)


def display(value, t: LType) -> str:
    if value is None:
        return "null"
    if t.kind == "mixed":
        return plain(mixed(value))
    if t.kind == "union":
        return display(*member(value, t))
    if t.kind == "float":
        return float_text(value)
    if t.kind == "bool":
        return "true" if value else "false"
    if t.kind == "list":
        return "[" + ", ".join(display(x, t.elem) for x in value) + "]"
    if t.kind == "record":
        return "{" + ", ".join(f"{n}:{display(value[n], x)}" for n, x in t.fields) + "}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return str(value)


def plain(value) -> str:
    """A mixed element, as display shows it."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}:{plain(x)}" for k, x in value.items()) + "}"
    return str(value)


def json_value(value, t: LType):
    """What ``dump`` takes."""
    if value is None:
        return None
    if t.kind == "mixed":
        return mixed(value)
    if t.kind == "union":
        return json_value(*member(value, t))
    if t.kind == "float":
        return float(value)
    if t.kind == "list":
        return [json_value(x, t.elem) for x in value]
    if t.kind == "record":
        return {n: json_value(value[n], x) for n, x in t.fields}
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def dump(value, indent: str | None = None, level: int = 0) -> str:
    """JSON with sorted keys; <, > and & are escaped, as are the two line separators."""
    if isinstance(value, dict):
        items = [dump(k) + (": " if indent else ":") + dump(value[k], indent, level + 1) for k in sorted(value)]
        return _wrapped("{", items, "}", indent, level)
    if isinstance(value, list):
        return _wrapped("[", [dump(x, indent, level + 1) for x in value], "]", indent, level)
    if isinstance(value, float):
        return float_json(value)
    if type(value) is int:
        return str(value)
    out = encode_basestring(value) if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(value, str) and ESCAPED.search(out):
        for c in "<>&  ":
            out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def _wrapped(left: str, items: list[str], right: str, indent: str | None, level: int) -> str:
    if not items or indent is None:
        return left + ",".join(items) + right
    pad = "\n" + indent * (level + 1)
    return left + pad + ("," + pad).join(items) + "\n" + indent * level + right


def json_texts(schema: Schema, indent: str | None = None, level: int = 0) -> list[tuple[str, int, Callable]]:
    """For each column in the order of names: what comes before its value, where it is, and the text of a value that isn't null."""
    pad = "" if indent is None else "\n" + indent * (level + 1)
    columns = sorted({n: (i, t) for i, (n, t) in enumerate(schema)}.items())
    return [(pad + dump(n) + (":" if indent is None else ": "), i, {"int": str, "float": lambda v: float_json(float(v)), "string": dump}.get(t.kind, lambda v, t=t: dump(json_value(v, t), indent, level + 1))) for n, (i, t) in columns]


def json_text(schema: Schema, indent: str | None = None, level: int = 0) -> Callable:
    """``dump`` of ``json_row``, for many rows of one schema."""
    texts = json_texts(schema, indent, level)
    if not texts:
        return lambda row: "{}"
    end = "}" if indent is None else "\n" + indent * level + "}"
    return lambda row: "{" + ",".join([name + ("null" if (v := row[i]) is None else f(v)) for name, i, f in texts]) + end


def json_row(row, schema: Schema) -> dict:
    return {n: json_value(row[i], t) for i, (n, t) in enumerate(schema)}

