"""Secret scanning with a recursive decoding worklist.

The patterns run over the text itself first (base spans).  Then a worklist
unwraps layers: percent escapes and Unicode escapes are decoded in place; runs
of base64, also over lines of one width, are decoded at all four alignments, so
that encoded parts are met wherever they begin in a run; compressed data (in base64
or percent escapes) are decompressed.  Every new layer is scanned and unwrapped again, until
nothing new appears.  What a layer holds is worked out once for each text, and a text
within itself is not taken up again, which ends cycles; each place where it
stands gets its own spans.  Each character of a layer knows the span of the original
text that it comes from, so every finding is reported as a span of the original
(code points, end exclusive).  Base spans are always kept.

Formats: %XX; \\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX, &#N; and &#xX;; base64 in both
alphabets, of bytes in whatever encoding that has ASCII as single bytes or as
UTF-16; gzip, zlib, bzip2 and xz, where they begin a run of base64 or follow one of
its separators (+ / - _), and raw deflate at a run's beginning.  Whatever is
decoded is scanned, printable or not; decoded bytes are only skipped if they have
no 14 ASCII characters in a row (the shortest secret, and what encodes one, has as many).

A finding within a run of base64 is reported from the separator before it to that
after it, as the encoded part may begin and end there, or as the whole run if all of
that is text; one in compressed data as all of these.

Edge cases: a null or empty text has no spans; equal spans found in several
layers are reported once; undecodable runs are plain text; bytes that are no
UTF-8 become replacement characters;
decompressed data are scanned to the end, in pieces of about `MOST_PLAIN`
characters that overlap by 1 MiB, so a nested run or a line without end that is
longer than that may be read in part only, where pieces meet;
repeated rows and extra columns pass through unchanged.
"""

from __future__ import annotations

import base64
import bisect
import bz2
import codecs
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitalis.llm import textkernel as tk
from orbitalis.llm.storage import map_rows

KINDS = ("assign", "access", "hex")
#: Patterns of the three kinds (fixed values); letters are ASCII ones.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_WORDS = ("passw", "secret", "token", "api")
MOST_PLAIN = 1 << 24
_STEP, _OVERLAP = 1 << 20, 1 << 20

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_SEPARATOR = re.compile(r"[/_+-]")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Escapes of the sign that begins an escape, several deep; such chains go at once, or each level would be a layer.
_CHAIN = re.compile(r"%(?:25){2,}(?=[0-9A-Fa-f]{2})|\\(?:u005[cC]){2,}(?=[uUx])|&(?:#38;|#[xX]26;){2,}(?=#)")
_TO_PLAIN = str.maketrans("-_", "+/")
#: Percent escapes that begin as compressed data do.
_PACKED_PERCENT = re.compile(r"(?:%1[fF]%8[bB]|(?:%78|x)%(?:01|5[eE]|9[cC]|[dD][aA])|%[fF][dD](?:7|%37)(?:z|%7[aA])|(?:B|%42)(?:Z|%5[aA])(?:h|%68))[^\s\"'<>&]*")
_HEADS = (b"\x1f\x8b", b"x\x01", b"x\x5e", b"x\x9c", b"x\xda", b"BZh", b"\xfd7zXZ\x00")
_ASCII = re.compile(rb"[\x20-\x7e]{14}")
_WIDE = tuple(re.compile(x) for x in (rb"(?:[\x09\x0a\x0d\x20-\x7e]\x00){14,}", rb"(?:\x00[\x09\x0a\x0d\x20-\x7e]){14,}"))

Span = tuple[str, int, int]


def find_secrets(text: str) -> list[Span]:
    """The base spans of a text, by kind and start."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


def in_order(spans: list[Span] | set[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Layer:
    """A decoded text.  cuts: positions in it where a run of characters begins;
    origin: for each run, its original start and end, and whether its characters
    are those of the original one for one."""

    def __init__(self, text: str, cuts: list[int], origin: list[tuple[int, int, bool]]):
        self.text, self.cuts, self.origin = text, cuts, origin

    @classmethod
    def root(cls, text: str) -> Layer:
        return cls(text, [0], [(0, len(text), True)])

    def _run(self, at: int) -> int:
        return bisect.bisect_right(self.cuts, at) - 1

    def span(self, start: int, end: int) -> tuple[int, int]:
        i, j = self._run(start), self._run(max(start, end - 1))
        a, _, plain = self.origin[i]
        lo = a + start - self.cuts[i] if plain else a
        b, hi, plain = self.origin[j]
        return lo, (b + end - self.cuts[j] if plain else hi)

    def replaced(self, pattern: re.Pattern[str], decode) -> Layer | None:
        """The layer in which matches are decoded in place, if that changes it."""
        out, cuts, origin, at, size = [], [], [], 0, 0

        def copy(to: int) -> None:
            nonlocal at, size
            while at < to:
                i = self._run(at)
                end = min(to, self.cuts[i + 1]) if i + 1 < len(self.cuts) else to
                a, b, plain = self.origin[i]
                cuts.append(size)
                origin.append((a + at - self.cuts[i], a + end - self.cuts[i], True) if plain else (a, b, False))
                out.append(self.text[at:end])
                size, at = size + end - at, end

        for m in pattern.finditer(self.text):
            got = decode(m[0])
            if got is None or got == m[0]:
                continue
            copy(m.start())
            if got:
                cuts.append(size)
                origin.append((*self.span(m.start(), m.end()), False))
                out.append(got)
                size += len(got)
            at = m.end()
        if not at:
            return None
        copy(len(self.text))
        return Layer("".join(out), cuts or [0], origin or [(0, 0, False)])


def _percent(run: str) -> str:
    return unquote_to_bytes(run).decode("utf-8", "replace")


def _code(n: int) -> str | None:
    return chr(n) if n <= 0x10FFFF and not 0xD800 <= n <= 0xDFFF else None


def _unicode(run: str) -> str | None:
    if run.startswith("&#"):
        return _code(int(run[3:-1], 16) if run[2] in "xX" else int(run[2:-1]))
    if run.startswith("\\u{"):
        return _code(int(run[3:-1], 16))
    if run.startswith("\\U"):
        return _code(int(run[2:], 16))
    if run.startswith("\\x"):
        return chr(int(run[2:], 16))
    return bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "replace")  # surrogate pairs are joined


def _packed(data: bytes) -> bool:
    return data.startswith(_HEADS)


def _decompressor(data: bytes):
    return bz2.BZ2Decompressor() if data[:1] == b"B" else lzma.LZMADecompressor() if data[:1] == b"\xfd" else zlib.decompressobj(47)


def _drained(unzip, data: bytes) -> Iterator[bytes]:
    """What data give, in steps, until the end of the stream or more data are needed."""
    while True:
        out = unzip.decompress(data, _STEP)
        data = getattr(unzip, "unconsumed_tail", b"")
        if out:
            yield out
        if unzip.eof or not (out or data):
            return


def _inflated(steps: Iterator[bytes], left: list[bytes] | None = None) -> Iterator[bytes]:
    """All members of compressed data, in steps, up to the end or an error; what
    follows them goes to `left`."""
    unzip, rest = None, b""
    for step in steps:
        rest += step
        while rest:
            if unzip is None:
                if not _packed(rest):
                    break
                unzip = _decompressor(rest)
            try:
                yield from _drained(unzip, rest)
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            rest = unzip.unused_data if unzip.eof else b""
            if unzip.eof:
                unzip = None
    if left is not None:
        left.append(rest)


def _unpacked(steps: Iterator[bytes], above: tuple[bytes, ...] = ()) -> Iterator[bytes]:
    """Decompressed as often as it is compressed; data that hold themselves end that."""
    first = next(steps, b"")
    if _packed(first) and first not in above:
        yield from _unpacked(_inflated(itertools.chain([first], steps)), (*above, first))
    else:
        yield first
        yield from steps


def _pieces(steps: Iterator[bytes]) -> Iterator[str]:
    """The text of the steps in pieces of about MOST_PLAIN characters that overlap; cut between lines if there are any."""
    decoder, text = codecs.getincrementaldecoder("utf-8")("replace"), ""
    held: list[str] = []
    size = 0
    for step in steps:
        held.append(decoder.decode(step))
        size += len(held[-1])
        if size > MOST_PLAIN:
            text = "".join(held)
            yield text
            back = text.find("\n", len(text) - _OVERLAP) + 1
            held = [text[back or len(text) - _OVERLAP :]]
            size = len(held[0])
    yield "".join([*held, decoder.decode(b"", True)])


def _raw(data: bytes) -> Iterator[bytes]:
    """What raw deflate data give, if they end as such."""

    def steps() -> Iterator[bytes]:
        unzip = zlib.decompressobj(-15)
        yield from _drained(unzip, data)
        if not unzip.eof:
            raise zlib.error("cut short")

    try:
        for _ in steps():
            pass
    except zlib.error:
        return
    yield from steps()


class _Memory:
    """What is known of one document's layers: spans by text, and by run of base64."""

    def __init__(self):
        self.texts: dict[bytes, set[Span]] = {}
        self.runs: dict[tuple[str, bool], set[Span]] = {}


def _inside(steps: Iterator[bytes], memory: _Memory) -> set[str]:
    """The kinds of secrets in decompressed data and all layers below."""
    found: set[str] = set()
    for piece in _pieces(steps):
        for text in (piece, piece.replace("\0", "")) if "\0" in piece else (piece,):  # UTF-16
            found.update(kind for kind, _, _ in _spans(text, memory))
        if len(found) == len(KINDS):
            break
    return found


def _unzipped(data: bytes, memory: _Memory) -> tuple[set[str], int]:
    """The kinds of secrets in compressed data, and how many bytes these are."""
    left: list[bytes] = []
    kinds = _inside(_unpacked(_inflated(iter([data]), left), (data,)), memory)
    return kinds, len(data) - len(left[0]) if left else len(data)


def _clean(data: bytes) -> bool:
    try:
        return all(c.isprintable() or c in "\n\r\t" for c in data.decode())
    except UnicodeDecodeError:
        return False


def _in_run(run: str, memory: _Memory, narrow: bool = False) -> set[Span]:
    """The spans, in a run of base64, of what it holds; narrow: not the whole run
    where all of it is text.

    Decoded from each of its first four characters on, the run gives the bytes of
    every part that is encoded on its own: parts begin after separators, at one of
    these alignments, and what stands around them can't be taken for theirs, as
    separators have the highest values.
    """
    if (run, narrow) in memory.runs:
        return memory.runs[run, narrow]
    memory.runs[run, narrow] = found = set()
    body = run.rstrip("=").translate(_TO_PLAIN)
    bounds = [0, *(m.end() for m in _SEPARATOR.finditer(run))]  # where parts may begin
    stops = [*(b - 1 for b in bounds[1:]), len(run)]  # and end
    for k in range(min(4, len(body))):
        chars = body[k:] if (len(body) - k) % 4 != 1 else body[k:-1]
        data = base64.b64decode(chars + "=" * (-len(chars) % 4))
        clean = k == 0 and len(chars) == len(body) and _clean(data)
        whole = clean and not narrow
        own = [b for b in bounds if b % 4 == k]

        def put(kind: str, i: int, j: int, k=k, whole=whole, own=own) -> None:
            a, b = k + 8 * i // 6, min(k - -8 * j // 6, len(run))
            at, to = bisect.bisect_right(own, a) - 1, bisect.bisect_left(stops, b)
            found.add((kind, 0, len(run)) if whole else (kind, own[at] if at >= 0 else a, stops[to]))

        if _ASCII.search(data):
            for span in _spans(data.decode("latin-1"), memory):
                put(*span)
        for wide, pattern in enumerate(_WIDE):
            for m in pattern.finditer(data):
                for kind, i, j in _spans(m[0][wide::2].decode("latin-1"), memory):
                    put(kind, m.start() + 2 * i, m.start() + 2 * j)
        if any(h in data for h in _HEADS):
            done = 0
            for b in own:
                at = (b - k) // 4 * 3
                if at >= done and data.startswith(_HEADS, at):
                    kinds, size = _unzipped(data[at:], memory)
                    for kind in kinds:
                        to = bisect.bisect_left(stops, min(b - -8 * size // 6, len(run)))
                        found.add((kind, b, stops[to]))
                    done = at + size if kinds else done  # what was read needn't be tried again
        if k == 0 and not clean and not _packed(data):
            for kind in _inside(_raw(data), memory):
                found.add((kind, 0, len(run)))
    return found


def _wrapped(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """Runs of base64 over several lines of one width, the last may be shorter:
    the joined run, and where its lines begin and end in the text."""
    for m in _LINES.finditer(text):
        spans = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m[0])]
        i = 0
        while i + 1 < len(spans):
            width, j = spans[i][1] - spans[i][0], i + 1
            while j < len(spans) and spans[j][1] - spans[j][0] == width:
                j += 1
            end = j + 1 if j < len(spans) and spans[j][1] - spans[j][0] < width else j
            if end - i > 1:
                yield "".join(text[a:b] for a, b in spans[i:end]), [a for a, _ in spans[i:end]], [b for _, b in spans[i:end]]
            i = j


def _spans(text: str, memory: _Memory) -> set[Span]:
    """All spans of a text: its own secrets and those of the layers below."""
    key = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
    if key in memory.texts:
        return memory.texts[key]
    memory.texts[key] = found = set()  # what a text holds of itself adds nothing
    found.update(find_secrets(text))
    work, seen = [Layer.root(text)], {text}

    def take(layer: Layer | None) -> None:
        if layer is not None and layer.text and layer.text not in seen:
            seen.add(layer.text)
            work.append(layer)
            for kind, a, b in find_secrets(layer.text):
                found.add((kind, *layer.span(a, b)))

    while work:
        layer = work.pop()
        if "%" in layer.text:
            for m in _PACKED_PERCENT.finditer(layer.text):
                for run in {m[0], m[0].replace("+", " ")}:
                    kinds, _ = _unzipped(unquote_to_bytes(run), memory)
                    found.update((kind, *layer.span(m.start(), m.end())) for kind in kinds)
        chained = layer.replaced(_CHAIN, lambda run: run[0]) if "%2525" in layer.text or "u005" in layer.text or "&#" in layer.text else None
        take(chained)
        if chained is None and "%" in layer.text:
            take(layer.replaced(_PERCENT, _percent))
        if chained is None and ("\\" in layer.text or "&#" in layer.text):
            take(layer.replaced(_UNICODE, _unicode))
        for m in _BASE64.finditer(layer.text):
            found.update((kind, *layer.span(m.start() + a, m.start() + b)) for kind, a, b in _in_run(m[0], memory))
        for run, starts, ends in _wrapped(layer.text):
            width = ends[0] - starts[0]
            for kind, a, b in _in_run(run, memory, True):  # the lines that it stands in
                found.add((kind, *layer.span(starts[a // width], ends[(b - 1) // width])))
    return found


def all_secrets(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, in order."""
    return in_order(find_secrets(text)), in_order(_spans(text, _Memory()))


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every (merged) span replaced by the mark."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


ROWS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string"


_ROWS = 500  # texts held as Python strings at a time


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)
        tk.release()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: doc_id, the counts of base spans, their digest, all spans and, if
    asked for, the redacted text (null where nothing was found)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                base, every = all_secrets(text or "")
                n = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*n, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(every), redact(text, every) if with_text and every else None))
            types = [pa.int64()] * 3 + [pa.string()] * 3
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    out = docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id {kind}, {ROWS}")
    return out if with_text else out.drop("redacted")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, with secrets replaced in the text; null stays null."""
    import pyspark.sql.types as T

    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [None if t is None else redact(t, all_secrets(t)[1], mark) for t in batch.column(at).to_pylist()]
            cols = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = T.StructType([T.StructField(f.name, T.StringType() if i == at else f.dataType, True) for i, f in enumerate(docs.schema)])
    return map_rows(docs, run, out)
