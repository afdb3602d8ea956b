"""Byte-level BPE: encoding of whole texts by overlapping chunks, and decoding by joining raw bytes.

A text of at most ``CHUNK`` characters is one chunk and is encoded where it is read.  A longer one
is cut into chunks that overlap by ``OVERLAP`` characters, which are pre-tokenised in parallel.  A chunk begins anywhere, so its
first boundaries may be wrong; pre-tokenising goes from left to right without memory, so from the first
boundary in the overlap that both neighbours have (and that follows a character other than white space, so that
no look-ahead is cut off) they agree.  There the chunks are stitched; every chunk's own piece is encoded in parallel,
and the pieces' tokens are put together in order.  A text whose neighbours do not meet in an overlap
(a run of thousands of letters, say) is encoded in one piece.

Tokens are exactly those of the whole text, for any text, as ordinary text: strings of special tokens have no
meaning.  Decoding joins each token's bytes for a batch at once in numpy.  The vocabulary is a file of public ranks, read once
by the driver and sent with the tasks (under 1 MB, whatever the data).

Of pairs with the same rank the first is merged, so there are no ties.
A null text has null tokens, an empty one none.  A null doc_id is kept; rows that repeat are
encoded each.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.store import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = 65_536
OVERLAP = 1_024

_MADE: dict[str, tuple] = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one vocabulary, made once in a process."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        by_id = [b""] * (max(table.values()) + 1)
        for raw, i in table.items():
            by_id[i] = raw
        self.lengths = np.array([len(b) for b in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    @staticmethod
    def of(ranks: bytes) -> "Codec":
        key = hashlib.sha256(ranks).hexdigest()
        if key not in _MADE:
            _MADE[key] = (Codec(ranks),)
        return _MADE[key][0]

    def encode(self, text: str) -> list[int]:
        try:
            return self.encoding.encode_ordinary(text)
        except BaseException as error:  # very long runs of white space are more than the compiled matcher's stack takes
            if type(error).__name__ not in ("PanicException", "RuntimeError", "ValueError"):
                raise
            return [t for piece in self.pattern.findall(text) for t in self.encoding._encode_single_piece(piece)]

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens that follow a character other than white space."""
        return [m.end() for m in self.pattern.finditer(text) if not text[m.end() - 1].isspace()]

    def decode(self, tokens: np.ndarray) -> np.ndarray:
        """The tokens' bytes, joined."""
        n = self.lengths[tokens]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[tokens] - (ends - n), n)
        return self.bytes[at + np.arange(len(at))]


ENCODED = "doc_id long, tokens array<int>, n_tokens int, round_trip boolean"
_TOKENS = pa.list_(pa.int32())


def _round_trips(codec: Codec, lists: list[list[int] | None], texts: list[str | None]) -> list[bool | None]:
    return [None if t is None else codec.decode(np.array(t, np.int64)).tobytes() == s.encode() for t, s in zip(lists, texts)]


def _encode(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):  # tokens as Python numbers are large
                batch = whole.slice(a, 256)
                texts = batch.column(1).to_pylist()
                lists = [None if t is None else codec.encode(t) for t in texts]
                count = pa.array([None if t is None else len(t) for t in lists], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, _TOKENS), count, pa.array(_round_trips(codec, lists, texts), pa.bool_())], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def _chunks(chunk: int, overlap: int):
    step = chunk - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                starts = range(0, max(len(text) - overlap, 1), step)
                for a in range(0, len(starts), 64):
                    part = starts[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * len(part)), pa.array(range(a, a + len(part)), pa.int64()), pa.array(part, pa.int64()), pa.array([text[s : s + chunk] for s in part])], names=["uid", "chunk", "begin", "part"])

    return run


def _boundaries(ranks: bytes, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            begins, heads, tails, ends = batch.column(2).to_pylist(), [], [], []
            for begin, part in zip(begins, batch.column(3).to_pylist()):
                cuts = codec.boundaries(part)
                heads.append([begin + c for c in cuts if c <= overlap])
                tails.append([begin + c for c in cuts if chunk - overlap <= c < len(part)])
                ends.append(begin + len(part))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(heads, many), pa.array(tails, many), pa.array(ends, pa.int64())], names=["uid", "chunk", "begin", "head", "tail", "finish"])

    return run


def _pieces(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            lists = [codec.encode(part[low - begin : high - begin]) for begin, part, low, high in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, _TOKENS)], names=["uid", "chunk", "ids"])

    return run


def _checked(ranks: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            lists, texts = batch.column(2).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(t) for t in lists], pa.int32()), pa.array(_round_trips(codec, lists, texts))], names=["doc_id", "tokens", "n_tokens", "round_trip"])

    return run


def encode_long(docs: DataFrame, ranks: bytes, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode (doc_id, text) of texts longer than a chunk, in parallel within each text."""
    whole = written(docs.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text"), "long")
    chunks = written(whole.select("uid", "text").mapInArrow(_chunks(chunk, overlap), "uid long, chunk long, begin long, part string").repartition("uid", "chunk"), "chunks")
    marks = chunks.mapInArrow(_boundaries(ranks, chunk, overlap), "uid long, chunk long, begin long, head array<long>, tail array<long>, finish long")
    w = Window.partitionBy("uid").orderBy("chunk")
    low = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(w))))
    marks = marks.select("uid", "chunk", "finish", low.alias("low"))
    marks = marks.withColumn("last", F.lead("chunk").over(w).isNull()).withColumn("high", F.when(F.col("last"), F.col("finish")).otherwise(F.lead("low").over(w)))
    marks = written(marks.withColumn("met", F.min(F.col("low").isNotNull()).over(Window.partitionBy("uid"))).select("uid", "chunk", "low", "high", "met"), "stitches")
    own = chunks.join(marks.where("met").select("uid", "chunk", "low", "high"), ["uid", "chunk"]).select("uid", "chunk", "begin", "part", "low", "high")
    ids = own.mapInArrow(_pieces(ranks), "uid long, chunk long, ids array<int>")
    ids = ids.groupBy("uid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ids"))), lambda s: s["ids"])).alias("tokens"))
    stitched = whole.join(ids, "uid").select("doc_id", "text", "tokens").mapInArrow(_checked(ranks), ENCODED)
    rest = whole.join(marks.where("not met").select("uid").distinct(), "uid", "left_semi").select("doc_id", "text")
    return stitched.unionByName(rest.mapInArrow(_encode(ranks), ENCODED))


def bpe_encode(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip): each text's tokens, and whether decoding gives its bytes again."""
    ranks = vocabulary(path)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = own.where(f"text is null or length(text) <= {chunk}").mapInArrow(_encode(ranks), ENCODED)
    return short.unionByName(encode_long(own.where(f"length(text) > {chunk}"), ranks, chunk, overlap))


def bpe_decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); bytes that are no UTF-8 become replacement characters."""
    ranks = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks)
        for batch in batches:
            texts = [None if t is None else codec.decode(np.array(t, np.int64)).tobytes().decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "tokens").mapInArrow(run, "doc_id long, text string")
