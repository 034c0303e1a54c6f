"""Secret scanning: keyword automaton first, anchored patterns at its hits, then embedded checksums.

An Aho-Corasick automaton finds the key words and token prefixes of every kind in one pass over the lower-cased
text; long hexadecimal runs have no key word, so their prefilter is the gap between characters that are not
hexadecimal digits, found for the whole text at once. Patterns run anchored at hits only. Tokens that carry a
checksum (``gh?_`` and ``npm_`` tokens end in a base-62 CRC-32 of their body) are kept only if it holds.

Nulls and odd rows: a null or empty text has no span; a null ``doc_id`` stays null; repeated rows are scanned
each for itself; an empty table gives an empty result. Texts are scanned whole, one at a time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CHECKED = re.compile(r"(?:gh[opsur]_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm")
WORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"),
    "akia": "access", **dict.fromkeys(("gho_", "ghp_", "ghs_", "ghu_", "ghr_"), "github"), "npm_": "npm",
}
_LOWER = {c: c + 32 for c in range(65, 91)}
_HEX = np.zeros(128, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True


def crc_base62(body: str) -> str:
    """The six closing characters of a checked token."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    words = ahocorasick.Automaton()
    for word, kind in WORDS.items():
        words.add_word(word, (len(word), kind))
    words.make_automaton()
    return words


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 16 hexadecimal digits."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.flatnonzero(~(_HEX[np.minimum(points, 127)]))
    edges = np.concatenate(([-1], stops, [len(points)]))
    for k in np.flatnonzero(np.diff(edges) > 16):
        yield int(edges[k]) + 1, int(edges[k + 1])


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span by start, then kind as listed; ends exclusive, in code points."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case has another length
        low = text.translate(_LOWER)
    spans: list[tuple[int, int, str]] = []
    hits = sorted((end - size + 1, kind) for end, (size, kind) in _automaton().iter(low))
    free = dict.fromkeys(KINDS, 0)  # matches of a kind don't overlap
    for at, kind in hits:
        if at < free[kind]:
            continue
        if kind == "assign" and (m := ASSIGN.match(text, at)):
            free[kind] = m.end()
            if m.end(2) - m.start(2) >= 12:
                spans.append((at, m.end(), kind))
        elif kind == "access" and (m := ACCESS.match(text, at)):
            free[kind] = m.end()
            if m.end() - at >= 18:
                spans.append((at, m.end(), kind))
        elif kind in ("github", "npm") and (m := CHECKED.match(text, at)) and crc_base62(m[1]) == m[2]:
            free[kind] = m.end()
            spans.append((at, m.end(), kind))
    for start, end in _hex_runs(text):
        if m := HEX.match(text, start, end):
            spans.append((start, m.end(), "hex"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


SPANS = "doc_id bigint, spans array<struct<start:bigint,end:bigint,kind:string>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])


def _scan_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [[dict(zip(("start", "end", "kind"), s)) for s in scan(t.as_py())] for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each row; spans are ordered by start."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scan_batches, SPANS)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, their digest and all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return find_secrets(docs).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"),
    )


def mask_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``; overlapping spans become one. Null stays null."""

    @F.pandas_udf("string")
    def masked(texts):
        def one(text):
            out, at = [], 0
            for start, end, _ in scan(text):
                if start >= at:
                    out += [text[at:start], mark]
                at = max(at, end)
            return None if text is None else "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn("text", masked(F.col("text").cast("string")))


