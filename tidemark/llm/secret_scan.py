"""Secret scans: an Aho-Corasick keyword pass, anchored expressions at its hits, checksums inside tokens.

Texts are scanned as UTF-8 bytes.  One automaton over the lower-cased bytes finds
the keywords; an expression is tried only where a keyword stands, anchored there.
Runs of hexadecimal digits have no keyword and are found by run length.  Spans are
in code points, end exclusive.

Kinds `assign`, `access` and `hex` are the base; matches are leftmost and do not
overlap within a kind, and those that are too short are dropped after matching.
Kinds of our own are kept only when a check inside the token holds: `github` and
`npm` (the last six base-62 digits are the CRC-32 of the body), `jwt` (the header
decodes to a JSON object with "alg"), `card` (Luhn
and a known issuer's prefix and length, after a card keyword) and `iban` (mod 97).
`pem` (a private-key block's first line) holds no checksum; the whole line must match.

Hits are taken as the automaton gives them, and a place that was read is not read
again for the same kind, so a scan is linear in the text.

Null texts count as empty and have no spans; every row is judged by itself.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, annotate

# Keywords and forms.
KINDS = ["assign", "access", "hex", "card", "github", "iban", "jwt", "npm", "pem"]
KEYWORDS = {
    "assign": [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"],
    "access": [b"akia"],
    "github": [b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"],
    "npm": [b"npm_"],
    "jwt": [b"eyj"],
    "card": [b"card number", b"credit card", b"card no"],
    "iban": [b"iban"],
    "pem": [b"-----begin "],
}
FORMS = {
    "assign": re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"),
    "card": re.compile(rb"(?:card number|credit card|card no)\W{1,4}((?:\d[ -]?){12,18}\d)(?!\d)", re.IGNORECASE),
    "iban": re.compile(rb"IBAN\W{1,3}([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "pem": re.compile(rb"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Card issuers: first and last prefix, lengths.
ISSUERS = [("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)), ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14, 16, 19)), ("36", "36", (14,)), ("38", "39", (14, 16)), ("50", "50", (12, 16, 19)), ("56", "58", (16, 19)), ("62", "62", (16, 19))]
MARK = "[REDACTED]"
#: Keyword hits that are held at once.
HITS = 1 << 16
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True

KIND = "kinds array<int>, starts array<int>, ends array<int>"


def base62_crc(token: bytes) -> bool:
    body, tail = token[4:-6], token[-6:]
    n = 0
    for c in tail:
        n = n * 62 + BASE62.index(c)
    return n == zlib.crc32(body)


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null|NaN|-?Infinity))')


def top_keys(text: str) -> set[str] | None:
    """The keys of a JSON object, None for any other JSON; ValueError where it is none.  Any depth: nothing recurs."""
    keys: set[str] = set()
    open_: list[str] = []  # brackets that are open
    want, at = "value", 0  # value, key, colon, next (comma or end); "or end" right after a bracket
    while at < len(text.rstrip(" \t\n\r")):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        mark, string, at = m[1], m[2], m.end()
        if want == "next" and mark == "," and open_:
            want = "key" if open_[-1] == "{" else "value"
        elif mark in ("}", "]") and open_ and open_[-1] == {"}": "{", "]": "["}[mark] and (want == "next" or want == {"}": "key or end", "]": "value or end"}[mark]):
            open_.pop()
            want = "next"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want.startswith("key") and string:
            if len(open_) == 1:
                keys.add(json.loads(string))
            want = "colon"
        elif want.startswith("value") and mark in ("{", "["):
            open_.append(mark)
            want = "key or end" if mark == "{" else "value or end"
        elif want.startswith("value") and not mark:
            want = "next"
        else:
            raise ValueError(f"unexpected JSON at {at}")
    if open_ or want != "next":
        raise ValueError("JSON is cut off")
    return keys if text.lstrip(" \t\n\r").startswith("{") else None


def json_header(m: re.Match) -> bool:
    try:
        raw = base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4))
        try:
            told = json.loads(raw)
        except RecursionError:  # deeper than the reader goes
            told = top_keys(raw.decode())
        return isinstance(told, dict | set) and "alg" in told
    except (ValueError, binascii.Error):
        return False


def issued(digits: bytes) -> bool:
    """Whether an issuer gives numbers of this beginning and length."""
    own = "".join(chr(c) for c in digits if 48 <= c < 58)
    return any(low <= own[: len(low)] <= high and len(own) in lengths for low, high, lengths in ISSUERS)


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits if 48 <= c < 58][::-1]
    return len(set(d)) > 1 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(d)) % 10 == 0


def mod97(code: bytes) -> bool:
    code = code.replace(b" ", b"")
    return int("".join(str(int(chr(c), 36)) for c in code[4:] + code[:4])) % 97 == 1


def holds(kind: str, m: re.Match) -> bool:
    """The check inside a match; for the base kinds, its length."""
    if kind == "assign":
        return len(m[2]) >= MIN_ASSIGN
    if kind == "access":
        return len(m[0]) >= MIN_ACCESS
    if kind in ("github", "npm"):
        return base62_crc(m[0])
    return {"jwt": json_header, "card": lambda m: issued(m[1]) and luhn(m[1]), "iban": lambda m: mod97(m[1]), "pem": lambda m: True}[kind](m)


_RUN = re.compile(rb"[A-Za-z0-9_-]*")


def finder():
    """f(data, offsets): (first byte, kind, past the last byte) of all spans of a chunk, by start and kind."""
    automaton = ahocorasick.Automaton()
    for kind, keys in KEYWORDS.items():
        for key in keys:
            automaton.add_word(key.decode(), (KINDS.index(kind), len(key)))
    automaton.make_automaton()
    jwt = KINDS.index("jwt")

    def run(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        raw = data.tobytes()
        spans: list[tuple[int, int, int]] = []
        taken = [0] * len(KINDS)
        found = automaton.iter(LOWER[data].tobytes().decode("latin-1"))
        while hits := [(end + 1 - n, kind) for end, (kind, n) in islice(found, HITS)]:
            # No keyword lies within another of its kind, so each kind's hits come by start.
            stops = offsets[np.searchsorted(offsets, [h[0] for h in hits], "right")].tolist()
            for (start, kind), stop in zip(hits, stops, strict=True):
                if start < taken[kind]:
                    continue  # inside what this kind has read
                m = FORMS[KINDS[kind]].match(raw, start, stop)
                if m:
                    taken[kind] = m.end()
                    if holds(KINDS[kind], m):
                        spans.append((start, kind, m.end()))
                elif kind == jwt:  # no later start in these characters can do better
                    taken[kind] = _RUN.match(raw, start, stop).end()
        inside = np.zeros(len(data) + 2, np.int8)
        inside[1:-1] = _HEX[data]
        turn = np.flatnonzero(np.diff(inside))
        first, last = turn[0::2], turn[1::2]
        long = last - first >= MIN_HEX
        for s, e in zip(first[long], last[long], strict=True):
            edges = offsets[np.searchsorted(offsets, s, "right") : np.searchsorted(offsets, e, "left")].tolist()
            for a, b in zip([int(s), *edges], [*edges, int(e)], strict=True):  # a run ends where its document does
                if b - a >= MIN_HEX:
                    spans.append((a, KINDS.index("hex"), b))
        return sorted(spans)

    return run


def by_row(spans: list[tuple[int, int, int]], offsets: np.ndarray):
    """(row, its spans) for the rows that have some."""
    at = np.searchsorted(offsets, [s[0] for s in spans], "right") - 1
    for own in np.split(np.arange(len(spans)), np.flatnonzero(np.diff(at)) + 1):
        if len(own):
            yield int(at[own[0]]), spans[own[0] : own[-1] + 1]


def scanner():
    """f(data, offsets) for annotate(): the spans of each row in code points."""
    find = finder()
    ints = pa.list_(pa.int32())

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        kinds, starts, ends = ([[] for _ in range(len(offsets) - 1)] for _ in range(3))
        for r, own in by_row(find(data, offsets), offsets):
            points = np.concatenate([[0], np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
            start, kind, end = (np.asarray(x) for x in zip(*own, strict=True))
            kinds[r], starts[r], ends[r] = kind, points[start - offsets[r]], points[end - offsets[r]]
        return [pa.array(x, ints) for x in (kinds, starts, ends)]

    return run


def redactor(mark: str):
    """f(data, offsets) for annotate(): each row's text without its spans, null where it has none."""
    find = finder()

    def run(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        clean: list[str | None] = [None] * (len(offsets) - 1)
        for r, own in by_row(find(data, offsets), offsets):
            parts, at = [], int(offsets[r])
            for start, _, end in own:
                if start >= at:
                    parts += [data[at:start].tobytes(), mark.encode()]
                at = max(at, end)
            clean[r] = b"".join([*parts, data[at : offsets[r + 1]].tobytes()]).decode()
        return [pa.array(clean, pa.string())]

    return run


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """docs with an array column of struct(kind, start, end), by start and then as KINDS lists them; its name is returned too."""
    out, name = annotate(docs, text, KIND, scanner, keep)
    x = F.col(name)
    names = F.array(*(F.lit(k) for k in KINDS))
    spans = F.zip_with(x["kinds"], F.arrays_zip(x["starts"].alias("s"), x["ends"].alias("e")), lambda k, at: F.struct(names[k].alias("kind"), at["s"].alias("start"), at["e"].alias("end")))
    return out.withColumn(name, spans), name


def redact(docs: DataFrame, *, text: str = "text", mark: str = MARK, length: str | None = None) -> DataFrame:
    """docs, all of them, with each stretch that spans cover replaced by `mark`; column `length`, if there, follows where a text changed."""
    out, name = annotate(docs, text, "clean string", lambda: redactor(mark))
    clean = F.col(name)["clean"]
    if length in docs.columns:
        out = out.withColumn(length, F.when(clean.isNotNull(), F.length(clean).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`")))
    return out.withColumn(text, F.coalesce(clean, F.col(f"`{text}`"))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op5(spark, sf_dir: str) -> DataFrame:
    out, c = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(F.col(c), lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter(F.col(c), lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col(c)).alias("spans"))
