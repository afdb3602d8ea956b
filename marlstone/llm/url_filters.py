"""URL filters: all glob rules at once, by a bit-parallel wildcard automaton over canonical URLs.

In a rule ``*`` is any run of characters, ``?`` any one byte, and ``\\\\`` takes the next character as it is; a rule
must match the whole canonical URL.  The symbols of all rules lie side by side as bits of a few
64-bit words.  For each byte a mask says which symbols accept it; a step shifts the set of
reached states by one, keeps what the mask allows and adds the states that a ``*`` lets stay (Shift-And with
loops), for every rule at once and, in numpy, for all the URLs of a batch.  URLs are taken longest first, so a
step touches only those that have a byte left.

Canonical: white space around and the fragment are gone, scheme and host are in lower case, a default port
is dropped, and an empty path is ``/``.  A null or blank URL matches nothing.  Rows
that repeat are answered each, and a null page_id is kept.  Other columns are ignored.  An empty
table or an empty list of rules is fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx

RULES = (
    "*://spam-farm.example.*/*",
    "*://*.spam-farm.example.*/*",
    "*://cheap-pills.example.*/*",
    "*://*.cheap-pills.example.*/*",
    "*://*casino*.example.*/*",
    "*://*.click/*",
    "*://*/*\\?*utm_source=*",
    "*://*/*[&?]ref=*",
    "*://m.*.example.net/*",
    "http://*/de/*.html",
    "*://*/login*",
    "*://???.???.???.???/*",
    "*.exe",
    "*.zip",
    "*://*@*/*",
    "*:8080/*",
)


def canonical_url(url: Column) -> Column:
    """The canonical form of a URL; an empty string for a null or blank one."""
    u = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"(?s)#.*$", "")
    head = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    rest = F.substring(u, F.length(head) + 1, F.length(u))
    low = F.regexp_replace(F.lower(head), r"^(http://[^/]*):80$|^(https://[^/]*):443$", "$1$2")
    return F.when(head == "", u).otherwise(F.concat(low, F.when(F.startswith(rest, F.lit("/")), F.lit("")).otherwise(F.lit("/")), rest))


def parse(rule: str) -> list[tuple[set[int] | None, bool]]:
    """Symbols of a rule: (accepted bytes, whether a run of anything may come before).  None as the last entry's bytes marks the end.

    ``[...]`` lists alternatives of single characters.
    """
    out: list[tuple[set[int] | None, bool]] = []
    raw, i, star = rule.encode(), 0, False
    while i < len(raw):
        c = raw[i]
        if c == 42:
            star = True
            i += 1
            continue
        if c == 63:
            accept = set(range(256))
        elif c == 91 and (end := raw.find(b"]", i + 2)) > 0:
            accept, i = set(raw[i + 1 : end]), end
        else:
            if c == 92 and i + 1 < len(raw):
                i += 1
            accept = {raw[i]}
        out.append((accept, star))
        star, i = False, i + 1
    out.append((None, star))
    return out


@dataclass
class Automaton:
    masks: np.ndarray  # (byte, word): symbols that accept the byte
    loops: np.ndarray  # (word): states in which a rule may stay
    begin: np.ndarray  # (word): the state before each rule's first symbol
    ends: list[tuple[int, int]]  # (word, bit) of each rule's last state

    @classmethod
    def of(cls, rules: tuple[str, ...]) -> "Automaton":
        parsed = [parse(r) for r in rules]
        words = max(1, -(-sum(map(len, parsed)) // 64))
        masks, loops, begin = np.zeros((256, words), np.uint64), np.zeros(words, np.uint64), np.zeros(words, np.uint64)
        at, ends = 0, []
        for symbols in parsed:
            begin[at // 64] |= np.uint64(1 << at % 64)
            for accept, star in symbols:
                if star:
                    loops[at // 64] |= np.uint64(1 << at % 64)
                if accept is not None:
                    for b in accept:
                        masks[b, (at + 1) // 64] |= np.uint64(1 << (at + 1) % 64)
                else:
                    ends.append((at // 64, at % 64))
                at += 1
        return cls(masks, loops, begin, ends)

    def matches(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, rules): which rules match which texts."""
        length = np.diff(offsets)
        order = np.argsort(-length, kind="stable")
        start, length = offsets[:-1][order], length[order]
        d = np.repeat(self.begin[None, :], len(order), axis=0)
        left = -length
        for t in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(left, -t, "left"))  # texts longer than t
            now = d[:n]
            step = now << np.uint64(1)
            step[:, 1:] |= now[:, :-1] >> np.uint64(63)
            step &= self.masks[raw[start[:n] + t]]
            step |= now & self.loops
            d[:n] = step
        out = np.zeros((len(order), len(self.ends)), bool)
        for k, (word, bit) in enumerate(self.ends):
            out[order, k] = (d[:, word] >> np.uint64(bit) & np.uint64(1)).astype(bool)
        return out


FILTERED = "page_id long, url string, rules array<int>, blocked boolean"


def _filter(rules: tuple[str, ...]):
    automaton = Automaton.of(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = tx.text_buffers(batch.column(1))
            lists = []
            for i, j in tx.slices(offsets, 1 << 20):
                hit = automaton.matches(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) if rules else np.zeros((j - i, 0), bool)
                hit[np.diff(offsets[i : j + 1]) == 0] = False
                lists.append(hit)
            hit = np.concatenate(lists) if lists else np.zeros((0, len(rules)), bool)
            which = np.nonzero(hit)[1].astype(np.int32)
            cut = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(cut), pa.array(which)), pa.array(hit.any(1))], names=["page_id", "url", "rules", "blocked"])

    return run


def url_filter(pages: DataFrame, rules: tuple[str, ...] = RULES) -> DataFrame:
    """(page_id, url, rules, blocked): each page's canonical URL and the numbers of the rules it matches."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), canonical_url(F.col("url")).alias("url")).mapInArrow(_filter(rules), FILTERED)


def regex(rule: str) -> str:
    """The rule as a regular expression, for SQL and tests."""
    out = "(?s)"
    for accept, star in parse(rule):
        out += ".*" if star else ""
        if accept is not None:
            out += "." if len(accept) == 256 else "[" + "".join(f"\\x{b:02x}" for b in sorted(accept)) + "]"
    return out
