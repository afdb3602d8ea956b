"""Repeated windows of words, by a depth-limited radix sort of all suffixes.

Two suffixes belong to the same repeated window if their first ``depth`` words
agree, so suffixes are ordered only that deep, most significant digit first.  A digit is
half of the depth: its words are hashed together, and digits are compared by hash.
Within a chunk of suffixes every window is reduced to its first occurrence before anything is sent: the others are known to be
later ones, so a passage that a third of all documents have is one entry a chunk.
Pass one distributes what is left by the leading bits of its first digit (the only shuffle
of all suffixes: eleven bytes each, packed, plus a share of the document list of
its chunk) and sorts by 24 bits more; suffixes without an equal leave.  Pass two
orders what is left by 40 bits of the second digit.  Groups of equals are then the
repeated windows: windows are told apart by 64 bits and the number of their hash range, which follows the size of the
input, so of the 10^8 windows of half a GB the expected number of pairs taken for equal wrongly is below 10^-5.

Within a group the occurrence with the smallest (doc_id, position) is the first and
stays; the later ones are what deduplication cuts.  Windows that overlap or touch merge to
spans, so a copied document is one span, however long.

Words are as in ``text``: case and punctuation count.  Rows without a doc_id, null
texts and texts of fewer words than the depth have no windows.  A very long text goes through many chunks.  Rows that repeat a
doc_id and its text are one document, and all of them are cut alike; a doc_id that repeats with another text (told by its CRC-32) is
another document, and of equal (doc_id, position) the smaller CRC-32 is first.  Other
columns are ignored or passed on.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import text as tx
from marlstone.llm.ngram_join import by_id, checked_broadcast, input_parts
from marlstone.llm.store import table_bytes, trimmed, written

DEPTH = 50
CHUNK = 1 << 20
"""Suffixes of a chunk; places in it take 20 bits, and one more says that a window repeats within the chunk."""


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` words from each position on, by doubling; the last length - 1 values mean nothing."""
    n = len(words)
    power, at, out, step = words, 0, None, 1
    while True:
        if length & step:
            if out is None:
                out = power.copy()
            else:
                m = max(n - at, 0)
                out[:m] = tx.mix(out[:m] * tx._K1 + power[at:])
            at += step
        step <<= 1
        if step > length:
            return out
        half = step >> 1
        power = power.copy()
        m = max(n - half, 0)
        power[:m] = tx.mix(power[:m] * tx._K3 + power[half:][:m])


_KINDS = ("head", "tail", "pos", "ids", "crcs", "starts", "bases", "counts", "at")
SUFFIXES = "part long, " + ", ".join(f"{k} binary" for k in _KINDS)
_SUFFIXES_ARROW = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in _KINDS)])
_FIRST = np.uint32(1 << 31)
_MANY = np.uint32(1 << 23)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _bytes(x: np.ndarray, n: int) -> bytes:
    """The lowest ``n`` bytes of each number."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :n].tobytes()


def _numbers(raw: bytes, n: int, kind: type) -> np.ndarray:
    out = np.zeros((len(raw) // n, np.dtype(kind).itemsize), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.view(kind).ravel()


def _tied(key: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array have an equal."""
    same = key[1:] == key[:-1]
    out = np.zeros(len(key), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def _by_document(doc: np.ndarray, crc: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, ids, crcs, numbers of positions, positions) of the documents of each part."""
    out = (tx.mix(doc.astype(np.uint64)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    order = np.lexsort((crc, doc, out))
    out, doc, crc, at = out[order], doc[order], crc[order], at[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1])]))
    counts = np.diff(np.append(edge, len(doc))).astype(np.uint32)
    owner = out[edge]
    for p in np.unique(owner):
        x, y = np.searchsorted(owner, [p, p + np.uint64(1)])
        u, v = edge[x], edge[y] if y < len(edge) else len(doc)
        yield int(p), doc[edge[x:y]].tobytes(), crc[edge[x:y]].tobytes(), counts[x:y].tobytes(), at[u:v].tobytes()


def _suffixes(depth: int, parts: int):
    one = depth // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            ids, crcs, bases = (np.array([h[k] for h in held], t) for k, t in ((2, np.int64), (3, np.uint32), (4, np.uint32)))
            lens = np.array([len(h[0]) for h in held])
            starts = np.cumsum(lens) - lens
            slot = np.repeat(np.arange(len(held), dtype=np.int32), lens)
            held, size = [], 0
            place = lambda own: bases[slot[own]] + (own - starts[slot[own]]).astype(np.uint32)
            order = np.argsort(a)  # ranges are in the order of the first digit
            tied = _tied(a[order])
            own = order[tied]
            rows: list[tuple] = []
            if len(own):
                at = place(own)
                own = own[np.lexsort((crcs[slot[own]], at, ids[slot[own]], b[own], a[own]))]
                at = place(own)
                doc, crc, x, y = ids[slot[own]], crcs[slot[own]], a[own], b[own]
                group = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
                new = group.copy()  # rows that repeat a document count once
                new[1:] |= (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (crc[1:] != crc[:-1])
                later = new & ~group
                rows += [(p, *[None] * 3, i, c, None, None, n, t) for p, i, c, n, t in _by_document(doc[later], crc[later], at[later], parts)] if later.any() else []
                many = np.add.reduceat(later, np.flatnonzero(group)) > 0
                own = own[group]
                order = np.concatenate([order[~tied], own])
                flag = np.concatenate([np.zeros(len(order) - len(own), np.uint32), np.where(many, _MANY, np.uint32(0))])
                again = np.argsort(a[order], kind="stable")
                order, flag = order[again], flag[again]
            else:
                flag = np.zeros(len(order), np.uint32)
            a, b = a[order], b[order]
            part = (((a >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint32)
            found, first = np.unique(part, return_index=True)
            for p, x, y in zip(found, first, np.append(first[1:], len(part))):
                mine = order[x:y]
                docs = np.unique(slot[mine])
                rows.append((int(p), _bytes(a[x:y], 3), _bytes(b[x:y], 5), _bytes(mine.astype(np.uint32) | flag[x:y], 3), ids[docs].tobytes(), crcs[docs].tobytes(), starts[docs].astype(np.uint32).tobytes(), bases[docs].tobytes(), None, None))
            return _batch(rows, _SUFFIXES_ARROW)

        for batch in batches:
            ids, crcs = batch.column(0).to_numpy(), batch.column(2).to_numpy().astype(np.uint32)
            raw, offsets = tx.text_buffers(batch.column(1))
            for i, j in tx.slices(offsets):
                w = tx.Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = w.hashes()
                a = window_hashes(h, one)
                b = a if depth == 2 * one else window_hashes(h, depth - one)
                for r in np.flatnonzero(w.counts >= depth):
                    at, n = int(w.bounds[r]), int(w.counts[r]) - depth + 1
                    base = 0
                    while base < n:
                        m = min(n - base, CHUNK - size)
                        x = at + base
                        held.append((a[x : x + m], b[x + one : x + one + m], ids[i + r], crcs[i + r], base))
                        size, base = size + m, base + m
                        if size == CHUNK:
                            yield flush()
        if held:
            yield flush()

    return run


_FOUND_KINDS = ("ids", "crcs", "counts", "pos")
FOUND = "part long, " + ", ".join(f"{k} binary" for k in _FOUND_KINDS)
_FOUND_ARROW = pa.schema([("part", pa.int64()), *((k, pa.binary()) for k in _FOUND_KINDS)])


def _groups(parts: int):
    def ties(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        head = np.concatenate([_numbers(r["head"], 3, np.uint32) for r in rows])
        place = np.concatenate([_numbers(r["pos"], 3, np.uint32) for r in rows])
        many, place = (place & _MANY) > 0, place & ~_MANY
        order = np.argsort(head)
        order = order[_tied(head[order]) | many[order]]  # pass one: suffixes alone with their first digit leave
        tail = np.concatenate([_numbers(r["tail"], 5, np.uint64) for r in rows])
        whole = head[order].astype(np.uint64) << np.uint64(40) | tail[order]
        again = np.argsort(whole)
        again = again[_tied(whole[again]) | many[order[again]]]  # pass two
        order, whole = order[again], whole[again]
        del head, tail
        if not len(order):
            return
        ids, crcs, pos, done = [], [], [], 0
        for r in rows:
            n = len(r["head"]) // 3
            at, done = place[done : done + n], done + n
            starts = np.frombuffer(r["starts"], np.uint32)
            slot = np.searchsorted(starts, at, "right") - 1
            ids.append(np.frombuffer(r["ids"], np.int64)[slot])
            crcs.append(np.frombuffer(r["crcs"], np.uint32)[slot])
            pos.append(np.frombuffer(r["bases"], np.uint32)[slot] + (at - starts[slot]))
        doc, crc, at = (np.concatenate(x)[order] for x in (ids, crcs, pos))
        many = many[order]
        order = np.lexsort((~many, crc, at, doc, whole))
        whole, doc, crc, at, many = whole[order], doc[order], crc[order], at[order], many[order]
        new = np.ones(len(doc), bool)  # rows that repeat a document count once
        new[1:] = (whole[1:] != whole[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (crc[1:] != crc[:-1])
        whole, doc, crc, at, many = whole[new], doc[new], crc[new], at[new], many[new]
        keep = _tied(whole) | many
        whole, doc, crc, at = whole[keep], doc[keep], crc[keep], at[keep]
        if not len(doc):
            return
        first = np.ones(len(doc), bool)
        first[1:] = whole[1:] != whole[:-1]
        at = at.astype(np.uint32) | np.where(first, _FIRST, np.uint32(0))
        yield _batch(list(_by_document(doc, crc, at, parts)), _FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, list[dict]] = {}
        for batch in batches:
            rows = batch.to_pylist()
            if known := [(r["part"], r["ids"], r["crcs"], r["counts"], r["at"]) for r in rows if r["at"] is not None]:
                yield _batch(known, _FOUND_ARROW)
            for r in rows:
                if r["at"] is None:
                    ranges.setdefault(r["part"], []).append(r)
            del rows
        for part in sorted(ranges):
            yield from ties(ranges.pop(part))

    return run


SPANS = "doc_id long, crc long, start_word int, end_word int, is_first boolean"
_SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("is_first", pa.bool_())])


def _spans(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                parts.setdefault(r["part"], []).append(r)
        for rows in parts.values():
            n = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows])
            doc = np.repeat(np.concatenate([np.frombuffer(r["ids"], np.int64) for r in rows]), n)
            crc = np.repeat(np.concatenate([np.frombuffer(r["crcs"], np.uint32) for r in rows]), n)
            at = np.concatenate([np.frombuffer(r["pos"], np.uint32) for r in rows])
            first, at = at >= _FIRST, (at & ~_FIRST).astype(np.int64)
            order = np.lexsort((at, first, crc, doc))
            doc, crc, at, first = doc[order], crc[order], at[order], first[order]
            cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (crc[1:] != crc[:-1]) | (first[1:] != first[:-1]) | (at[1:] > at[:-1] + depth)])
            edge = np.flatnonzero(cut)
            last = np.append(edge[1:], len(at)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(doc[edge]), pa.array(crc[edge].astype(np.int64)), pa.array(at[edge].astype(np.int32)), pa.array((at[last] + depth).astype(np.int32)), pa.array(first[edge])], schema=_SPANS_ARROW)

    return run


def _repeated(docs: DataFrame, depth: int) -> DataFrame:
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    parts = input_parts(own)
    found = by_id(own.mapInArrow(trimmed(_suffixes(depth, parts)), SUFFIXES), parts, "part").mapInArrow(trimmed(_groups(parts)), FOUND)
    return by_id(found, parts, "part").mapInArrow(trimmed(_spans(depth)), SPANS)


def repeated_spans(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, start_word, end_word, is_first): where ``depth`` words or more occur elsewhere too.

    ``is_first`` spans are covered by windows whose first occurrence this is, others by later
    occurrences; the two may overlap.  Words count from 0; end_word is exclusive.
    """
    return _repeated(docs, depth).select("doc_id", "start_word", "end_word", "is_first")


def _without(raw: bytes, spans: list[dict]) -> tuple[bytes, bool]:
    """A text without the words of the spans, and whether any word is left; a word goes with the white space after it."""
    w = tx.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    gone = np.zeros(len(w.start) + 1, np.int32)
    for s in spans:
        gone[s["start_word"]] += 1
        gone[s["end_word"]] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    begin, end = w.start, np.append(w.start[1:], len(raw))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    head = raw[: begin[0]] if keep[0] else b""
    return head + b"".join(raw[begin[a] : end[b - 1]] for a, b in zip(edge[::2], edge[1::2])), bool(keep.any())


def _cut(names: list[str], text: int, chars: int | None):
    def changed(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists, columns = batch.column(1), batch.column(0).flatten()
        rows = np.flatnonzero(np.asarray(lists.is_valid()))
        keep = np.ones(batch.num_rows, bool)
        made, counts = [], []
        for r in rows.tolist():
            raw, keep[r] = _without(columns[text][r].as_py().encode(), lists[r].as_py())
            made.append(raw)
            counts.append(len(raw.decode()))
        hit = pa.array(np.asarray(lists.is_valid()))
        columns[text] = columns[text].cast(pa.binary() if pa.types.is_string(columns[text].type) else pa.large_binary())
        columns[text] = pc.replace_with_mask(columns[text], hit, pa.array(made, columns[text].type)).cast(pa.string() if pa.types.is_binary(columns[text].type) else pa.large_string())
        if chars is not None:
            columns[chars] = pc.replace_with_mask(columns[chars], hit, pa.array(counts, columns[chars].type))
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = tx.text_buffers(batch.column(0).field(text))
            for i, j in tx.slices(offsets):  # so that what is built anew is bounded, however large the batch
                part = batch.slice(i, j - i)
                yield changed(part) if part.column(1).null_count < j - i else pa.RecordBatch.from_arrays(part.column(0).flatten(), names=names)

    return run


def without_repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The documents with every later occurrence of a repeated window cut out of the text.

    All columns stay; ``n_chars``, if there, is counted again where a text changes.  A
    document of which nothing is left goes; one without words stays.
    """
    spans = written(_repeated(docs, depth).where("not is_first"), "spans")
    listed = spans.groupBy(F.col("doc_id").alias("cut_id"), F.col("crc").alias("cut_crc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))
    listed = checked_broadcast(listed, table_bytes(spans) * 8)
    own = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("id"), F.crc32(F.encode("text", "UTF-8")).alias("crc"))
    joined = own.join(listed, (F.col("id") == F.col("cut_id")) & (F.col("crc") == F.col("cut_crc")), "left").select("doc", "spans")
    names = docs.columns
    return joined.mapInArrow(trimmed(_cut(names, names.index("text"), names.index("n_chars") if "n_chars" in names else None)), docs.schema)
