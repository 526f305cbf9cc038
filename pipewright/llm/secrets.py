"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned for secrets, then unwrapped: percent escapes, Unicode escapes,
characters of two or four bytes, base64 runs (at each of their four alignments, and joined where they are wrapped over lines),
and compressed bytes (gzip, zlib, bzip2, xz, zstandard; all members and frames) wherever they start. What comes out is a new
layer, until nothing new comes out. Layers are bytes where they came out of bytes, so no layer is left out for what it holds.
Layers seen before are not scanned again, so an encoding that leads back to itself ends. Every layer knows, for each of its
characters, which span of the text it came from, so a secret found deep down is reported where its encoded form stands.

The worklist is a stack of generators: a compressed layer is read window by window, and a window is done with, all that is in
it included, before the next one is made. Memory is bounded by the text and by the layers that lie in each other, not by
what they unfold to.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("assign", "access", "hex")
# Patterns of the base kinds. Letters of the first match in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}+")
KEYWORDS = ("passw", "secret", "token", "api")
# Escapes that escape their own first character again, to whatever depth, are one escape.
PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
QUOTED = re.compile(r"[A-Za-z0-9_.~!*'()/+%-]{12,}+")
ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ONE_ESCAPE = re.compile(
    r"\\(?:u005[cC]|x5[cC]|U0000005[cC])*(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8})|u\{([0-9A-Fa-f]{1,6})\})"
    r"|&(?:amp;|#0*38;|#[xX]0*26;)*#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));"
)
ESCAPE = re.compile(f"(?:{re.sub('[(](?![?])', '(?:', ONE_ESCAPE.pattern)})+")
WIDE = re.compile(r"(?:[\t\n\r -~]\x00{3}){6,}|(?:\x00{3}[\t\n\r -~]){6,}|(?:[\t\n\r -~]\x00){6,}|(?:\x00[\t\n\r -~]){6,}")
#: What texts with wide characters have somewhere.
WIDE_HINT = re.compile(r"\x00(?:[\t\n\r -~]\x00[\t\n\r -~]\x00|\x00\x00[\t\n\r -~])")
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}+={0,2}")
#: A run goes on in the next line; the end of a line may be escaped.
WRAP = re.compile(r"(?:\\r)?\\n|\r?\n[ \t]*")
WRAPPED = re.compile(r"(?:(?:(?:\\r)?\\n|\r?\n[ \t]*)[A-Za-z0-9+/_-]{2,}+)+={0,2}")
#: Decoded bytes without any of this hold neither a secret nor another layer.
TELLING = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{24}|%[0-9A-Fa-f]{2}|\\[uxU]|&(?:#|amp)|[A-Za-z0-9+/_-]{16}|[\t\n\r -~]\x00{1,3}[\t\n\r -~]\x00")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9](?:1AY&SY|\x17rE8P\x90)|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
ZLIB = re.compile(rb"x[\x01\x5e\x9c\xda]")
#: Bytes of an unfolding layer that are read at once, what windows have in common at least, and the longest base64 run that is
#: kept whole for the next window (a longer one is read as a stream of its own).
WINDOW, OVERLAP, LONGEST = 2 << 20, 64 << 10, 4 << 20
#: Bytes that a decompressor gives at once, and the memory that one may ask for (xz dictionaries, zstandard windows).
STEP, MEMORY = 1 << 18, 128 << 20
#: Compressions directly inside each other; beyond, it is taken for one that never ends.
NESTED = 64
SPACES = re.compile(rb" {1024,}")


class Layer(NamedTuple):
    """A text and how it maps to the layer that it came out of (``parent``; the base text has none).

    ``starts``: where its segments start. ``first``, ``last``: for each, where it comes from in the parent and where that ends;
    -1: it is a copy, character by character. All characters of other segments come from the whole of that span.
    Layers out of bytes hold a character for each byte.
    """

    text: str
    parent: "Layer | None" = None
    starts: array = array("q")
    first: array = array("q")
    last: array = array("q")
    #: Made of bytes by taking some for escapes, so what looks compressed in it is damaged.
    spoilt: bool = False

    def base(self, start: int, end: int) -> tuple[int, int]:
        """The span of the base text that a span of this layer came from."""
        layer = self
        while layer.parent is not None:
            i, j = bisect_right(layer.starts, start) - 1, bisect_right(layer.starts, end - 1) - 1
            a, b = layer.first[i], layer.last[j]
            start, end = a + (start - layer.starts[i] if layer.last[i] < 0 else 0), layer.first[j] + end - layer.starts[j] if b < 0 else b
            layer = layer.parent
        return start, end

    def where(self) -> tuple[int, int] | None:
        """The one span that everything here came from, if there is one."""
        layer = self
        while layer.parent is not None:
            if len(layer.first) == 1 and layer.last[0] >= 0:
                return layer.base(0, 1)
            layer = layer.parent
        return None

    def inner(self, text: str, start: int, end: int) -> "Layer":
        """A layer of which everything comes from one span of this one."""
        return Layer(text, self, array("q", [0]), array("q", [start]), array("q", [end]))


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each base match, leftmost and non-overlapping within its kind."""
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield "access", m.start(), m.end()
    for m in HEX.finditer(text):
        yield "hex", m.start(), m.end()


Pieces = Iterator[tuple[str, int, int]]


def rewritten(layer: Layer, pattern: re.Pattern, decode: Callable[[str], Pieces]) -> Layer | None:
    """The layer with every match of ``pattern`` decoded; None if nothing changed."""
    if layer.where() is not None:  # all of it comes from one span, so places don't matter
        text, n = pattern.subn(lambda m: "".join([t for t, _, _ in decode(m[0])]), layer.text)
        return layer.inner(text, 0, len(layer.text)) if n else None
    parts: list[str] = []
    starts, first, last = array("q"), array("q"), array("q")
    at = length = 0

    def add(text: str, start: int, end: int) -> None:
        nonlocal length
        if text:
            parts.append(text)
            starts.append(length)
            first.append(start)
            last.append(end)
            length += len(text)

    for m in pattern.finditer(layer.text):
        add(layer.text[at : m.start()], at, -1)
        for t, s, e in decode(m[0]):
            add(t, m.start() + s, m.start() + e)
        at = m.end()
    if not at:
        return None
    add(layer.text[at:], at, -1)
    return Layer("".join(parts), layer, starts, first, last)


def percent(run: str) -> Pieces:
    """A run of percent escapes as (character, start, end). A byte that isn't UTF-8 is the character of its number."""
    data, ends, at = bytearray(), array("q", [0]), 0
    for m in ONE_PERCENT.finditer(run):
        data.append(int(m[1], 16))
        ends.append(m.end())
    for c in data.decode("utf-8", "surrogateescape"):
        odd = "\udc80" <= c <= "\udcff"
        n = 1 if odd or c < "\x80" else len(c.encode())
        yield chr(ord(c) - 0xDC00) if odd else c, ends[at], ends[at + n]
        at += n


def escapes(run: str) -> Pieces:
    """A run of Unicode escapes; numbers beyond Unicode stay as they are."""
    high: tuple[str, int, int] | None = None
    for m in ONE_ESCAPE.finditer(run):
        code = int(m[6]) if m[6] else int(next(x for x in m.groups() if x), 16)
        if high:
            if 0xDC00 <= code < 0xE000:
                yield chr(0x10000 + ((ord(high[0]) - 0xD800) << 10) + code - 0xDC00), high[1], m.end()
                high = None
                continue
            yield high
            high = None
        if code > 0x10FFFF:
            yield from ((c, m.start() + i, m.start() + i + 1) for i, c in enumerate(m[0]))
        elif 0xD800 <= code < 0xDC00:
            high = (chr(code), m.start(), m.end())
        else:
            yield chr(code), m.start(), m.end()
    if high:
        yield high


def narrow(run: str) -> Pieces:
    """A run of characters of two or four bytes."""
    n = 4 if "\0\0\0" in run[:5] else 2
    return ((run[i : i + n].strip("\0"), i, i + n) for i in range(0, len(run), n))


class Feed:
    """Chunks of bytes, of which what was taken too much can be given back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.back, self.seen = chunks, b"", b""

    def next(self) -> bytes:
        """The next chunk; none at the end."""
        if self.back:
            out, self.back = self.back, b""
            return out
        return next((c for c in self.chunks if c), b"")

    def head(self, n: int = 16) -> bytes:
        """The first bytes of what is left, ``n`` if there are so many."""
        while len(self.back) < n and (more := next((c for c in self.chunks if c), b"")):
            self.back += more
        return self.back[:n]

    def read(self, n: int) -> bytes:
        out = self.next()
        self.back = out[n:]
        return out[:n]


def codec(data: bytes) -> str | None:
    if data[:3] == b"\x1f\x8b\x08":
        return "gzip"
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return "zstandard"
    if len(data) > 5 and ZLIB.match(data):
        return "zlib"
    return None


def sound(data: bytes) -> bool:
    """Whether zlib data is whole. Its two bytes of a head are often there by chance, so what comes before damage says little."""
    if len(data) < 6 or data[0] & 15 != 8 or data[0] >> 4 > 7 or (data[0] << 8 | data[1]) % 31:
        return False
    tool = zlib.decompressobj()
    try:
        while not tool.eof and (tool.decompress(data, STEP) or tool.unconsumed_tail):
            data = tool.unconsumed_tail
    except zlib.error:
        return False
    return tool.eof


def inflated(feed: Feed) -> Iterator[bytes]:
    """What compressed bytes unfold to, all members and frames, in chunks of about STEP bytes; up to where they are damaged.
    What follows stays in ``feed``; after damage, the chunk that has it too."""
    data = b""
    try:
        while kind := codec(feed.head()) or ("zlib" if sound(feed.back) else None):
            if kind in ("gzip", "zlib"):
                tool = zlib.decompressobj(47)
            elif kind == "zstandard":
                tool = zstandard.ZstdDecompressor(max_window_size=MEMORY).decompressobj()
            else:
                tool = bz2.BZ2Decompressor() if kind == "bzip2" else lzma.LZMADecompressor(memlimit=MEMORY)
            if kind == "zstandard":  # it gives all at once, so it gets little at a time
                while not tool.eof and (data := feed.read(256)):
                    yield tool.decompress(data)
                if not tool.eof:
                    return
                feed.back, data = tool.unused_data + feed.back, b""
                continue
            rest = b""
            while not tool.eof:
                fresh = rest or (feed.next() if kind in ("gzip", "zlib") or tool.needs_input else b"")
                data = fresh or data
                out = tool.decompress(fresh, STEP)
                rest = tool.unconsumed_tail if kind in ("gzip", "zlib") else b""
                if out:
                    yield out
                if not fresh and not out and not tool.eof:
                    return  # it ends too soon
            feed.back, data = tool.unused_data + feed.back, b""
    except (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError, MemoryError):
        feed.back = data + feed.back


def base64_bytes(run: bytes) -> bytes:
    """The bytes of a run from its start on, in either alphabet."""
    run = run[: len(run) - (len(run) % 4 == 1)].replace(b"-", b"+").replace(b"_", b"/")
    return binascii.a2b_base64(run + b"=" * (-len(run) % 4))


def going_on(run: bytes, feed: Feed, aside: Callable[[bytes], None]) -> Iterator[bytes]:
    """The bytes of a long base64 run that goes on in ``feed``. Its letters are shown to ``aside``; ``feed.seen`` are the last of them."""
    feed.seen = run[-OVERLAP:]
    while True:
        whole = len(run) // 4 * 4
        yield base64_bytes(run[:whole])
        run, more = run[whole:], feed.next()
        own = len(more) - len(more.lstrip(LETTERS))
        aside(feed.seen + more[:own])
        feed.seen = (feed.seen + more[:own])[-OVERLAP:]
        run += more[:own]
        if own < len(more) or not more:
            feed.back = more[own:] + feed.back
            yield base64_bytes(run)
            return


def windows(feed: Feed, aside: Callable[[bytes], None]) -> Iterator[bytes]:
    """Windows of a byte stream that hold its words and base64 runs whole; of a longer run also what it decodes to."""
    held = b""
    while chunk := feed.next():
        held += chunk
        if len(held) < WINDOW:
            continue
        run = len(held) - len(held.rstrip(LETTERS))
        if OVERLAP < run <= LONGEST and len(held) < WINDOW + LONGEST:
            continue
        yield held
        if run > LONGEST:
            yield from stream(Feed(going_on(held[-run:], feed, aside)), aside, 1)
            held = feed.seen
        else:
            held = SPACES.sub(b" ", held[-max(run, OVERLAP) :])
    if held:
        yield held


def stream(feed: Feed, aside: Callable[[bytes], None], nested: int = 0, seen: frozenset[bytes] = frozenset()) -> Iterator[bytes]:
    """Windows of what a byte stream unfolds to, through any number of compressions (NESTED at most), and of the rest of it."""
    head = feed.head(1 << 16)
    own = hashlib.blake2b(head, digest_size=16).digest()
    if codec(head) and nested < NESTED and (own not in seen or len(head) >= 1 << 16):
        yield from stream(Feed(inflated(feed)), aside, nested + 1, seen | {own})
    yield from windows(feed, aside)


def runs(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Base64 runs, and those of several lines, as their letters and (first letter, start, end) of each line."""
    until = 0
    for m in RUN.finditer(text):
        yield m[0].rstrip("="), [(0, m.start(), m.end())]
        if m.start() >= until and not m[0].endswith("=") and (more := WRAPPED.match(text, m.end())):
            lines, body, at = [(0, m.start(), m.end())], m[0], m.end()
            until = more.end()
            while at < until:
                start = WRAP.match(text, at).end()
                at = next((w.start() for w in WRAP.finditer(text, start, until)), until)
                lines.append((len(body), start, at))
                body += text[start:at]
            yield body.rstrip("="), lines


def unwrapped(layer: Layer, aside: Callable[[Layer], None]) -> Iterator[Layer]:
    """The layers that come out of a layer. ``aside`` gets layers that turn up while another one is read."""
    text = layer.text
    data = b"" if layer.parent is None or layer.spoilt else text.encode("latin-1", "replace")
    packed = [m.start() for m in MAGIC.finditer(data)]
    if "%" in text and (out := rewritten(layer, PERCENT, percent)):
        yield out._replace(spoilt=layer.spoilt or bool(packed))
    if any(x in text for x in ("\\u", "\\x", "\\U", "&#", "&amp;")) and (out := rewritten(layer, ESCAPE, escapes)):
        yield out._replace(spoilt=layer.spoilt or bool(packed))
    if WIDE_HINT.search(text) and (out := rewritten(layer, WIDE, narrow)):
        yield out._replace(spoilt=layer.spoilt or bool(packed))

    def unfolded(data: bytes, hits: list[int], start: int, end: int, exact: bool = False) -> Iterator[Layer]:
        """What starts at the ``hits`` in ``data``, which came from start to end (``exact``: byte by byte)."""
        done = -1
        for at in hits:
            if at <= done:  # a later member of what was read already
                continue
            feed = Feed(iter([data[at:]]))
            low = start + at if exact else start
            beside = lambda b, low=low: aside(layer.inner(b.decode("latin-1"), low, end))
            for window in stream(Feed(inflated(feed)), beside, 1):
                high = start + len(data) - len(feed.back) if exact and feed.back and len(feed.back) < len(data) - at else end
                yield layer.inner(window.decode("latin-1"), low, high)
            done = len(data) - len(feed.back) - 1

    starts_of = lambda pattern, data: [m.start() for m in pattern.finditer(data)]
    yield from unfolded(data, packed, 0, len(text), True)
    if "%" in text:
        for m in QUOTED.finditer(text):  # with the bytes that need no escape
            if "%" in m[0] and MAGIC.search(data := unquote_to_bytes(ONE_PERCENT.sub(r"%\1", m[0]))):
                yield from unfolded(data, starts_of(MAGIC, data), m.start(), m.end())
    for body, lines in runs(text):
        letters = body.encode()
        for skip in range(4):
            data = base64_bytes(letters[skip:])
            if TELLING.search(data):
                starts = array("q", [max(0, first - skip) * 3 // 4 for first, _, _ in lines])
                yield Layer(data.decode("latin-1"), layer, starts, array("q", [s for _, s, _ in lines]), array("q", [e for _, _, e in lines]))
            cut = lambda at, skip=skip: at % 3 == 0 and (skip + at // 3 * 4 == 0 or letters[skip + at // 3 * 4 - 1] in b"/_+-")
            found = starts_of(MAGIC, data) + [at for at in starts_of(ZLIB, data) if cut(at) and (at == skip == 0 or sound(data[at:]))]
            if not skip and 0 not in found and sound(data):
                found.append(0)
            yield from unfolded(data, sorted(found), lines[0][1], lines[-1][2])


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], int]:
    """(base spans, all spans, layers) of one whole text; spans are (start, end, kind) in code points, sorted by start, then
    kind as in KINDS, then end. A null text is empty."""
    text = text or ""
    base = [(s, e, k) for k, s, e in matches(text)]
    spans, seen, layers = set(base), set(), 0

    def fresh(layer: Layer) -> bool:
        key = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), layer.where()
        if key in seen:
            return False
        seen.add(key)
        return True

    def explore(layer: Layer) -> None:
        nonlocal layers
        work = [iter([layer])]
        while work:
            layer = next(work[-1], None)
            if layer is None:
                work.pop()
            elif layer.text and fresh(layer):
                layers += 1
                if layer.parent is not None:
                    for kind, start, end in matches(layer.text):
                        spans.add((*layer.base(start, end), kind))
                work.append(unwrapped(layer, explore))

    explore(Layer(text))
    order = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=order), sorted(spans, key=order), max(1, layers)


def scan_secrets(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``base_spans`` and ``spans`` (arrays of start, end, kind) and ``layers`` to each row.

    Null and empty texts have no spans. Rows are independent; repeated rows give repeated results. An empty table stays empty.
    A very long text is held whole, with some 40 bytes for each character that an escape decodes to; what compressed layers unfold
    to is read in windows (see WINDOW), however long it is. Escapes nested in turn in several ways are decoded layer by layer,
    which takes time in proportion to text times depth. Other columns pass through (``keep_text=False``: but for the text);
    columns of the names above are replaced, a text column of such a name is read first.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = ["base_spans", "spans", "layers"]
    span = "array<struct<start: long, end: long, kind: string>>"
    added = StructType.fromDDL(f"base_spans {span}, spans {span}, layers int")
    kept = [f for f in df.schema.fields if f.name not in names and (keep_text or f.name != text)]
    schema, arrow = StructType([*kept, *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py()) for x in batch.column(batch.schema.get_field_index(text))]
            spans = lambda rows: [[{"start": s, "end": e, "kind": k} for s, e, k in r] for r in rows]
            columns = [
                pa.array(spans(x[0] for x in found), arrow.field(0).type),
                pa.array(spans(x[1] for x in found), arrow.field(1).type),
                pa.array([x[2] for x in found], pa.int32()),
            ]
            own = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*own, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def op2_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets: counts of the base kinds and the spans as text."""
    from pyspark.sql import functions as F

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(joined("base_spans"), 256).alias("base_sha256")
    return found.select("doc_id", *[count(k) for k in KINDS], base, joined("spans").alias("spans"), "layers")
