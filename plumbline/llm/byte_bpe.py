"""Byte-level BPE by tree reduction: encoded halves of a text are joined at their boundary.

An encoded segment is an element of a monoid. ``Segment`` covers a range of
characters of a text and holds the ids that the range has as a text of its own;
``ByteBpe.join`` makes the segment of two neighbours. Two facts make the joins
exact and local:

* Pieces. The pattern is scanned from left to right and looks at most
  ``LOOKAHEAD`` characters past the end of a match, never behind its start. So
  the matches of the left half that end that far before its end stay, and once
  the scan of the whole starts a match where the right half has one, all later
  matches are the right half's. Only what lies between is encoded again.
* Tokens of one piece. A sequence of tokens is the encoding of its bytes if each
  two neighbours are the encoding of theirs: the merges of the whole that lie in
  a pair of neighbours are, in their order, the merges of the pair alone, for the
  lowest rank (the leftmost of equals) of the whole is the lowest of the pair it
  lies in; the first merge across a boundary would therefore happen in that pair
  alone. So a window around the boundary is encoded again, and grows until its
  first and last token agree with the tokens beside it.

Decoding concatenates the bytes of tokens up a tree of the same shape.

What counts as a letter or number is what the ``regex`` library's tables say;
these may know letters of later Unicode versions than tiktoken's.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import with_text_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters past the end of a match that the pattern can look at ("'re" after "'"; a blank and the letter behind it).
LOOKAHEAD = 2
#: Leaves of the trees: characters of a text, bytes of a piece, ids of a decoded range.
TEXT_LEAF, PIECE_LEAF, IDS_LEAF = 8_192, 64, 4_096
#: Bytes that a plain search for the lowest pair merges; longer windows take a heap.
SCANNED = 64
#: Pieces of a cache generation, and the longest piece that it holds.
CACHED_PIECES, CACHED_LENGTH = 250_000, 48
#: Ids of a result batch; a longer text is a batch of its own.
BATCH_IDS = 1_000_000
#: End of a range of ranks.
NEVER = 1 << 62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Segment(NamedTuple):
    """Characters ``start`` to ``end`` of a text as a text of their own.

    ``ids`` are little-endian signed 32-bit ids. All matches that end at or
    before ``safe`` stay when text follows; ``open_bytes`` of ``ids`` lie after.
    """

    start: int
    end: int
    ids: bytes
    safe: int
    open_bytes: int


class _Pieces(dict):
    """Ids of pieces, in two generations, so that a worker's memory is bounded."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = self.encode(piece.encode())
        if len(piece) <= CACHED_LENGTH:
            self[piece] = found
        return found

    def turn(self) -> None:
        if len(self) > CACHED_PIECES:
            self.old = dict(self)
            self.clear()


class ByteBpe:
    """Encoder and decoder of one rank file and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, text_leaf: int = TEXT_LEAF, piece_leaf: int = PIECE_LEAF) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.text_leaf, self.piece_leaf = max(text_leaf, 1), max(piece_leaf, 1)
        self.pieces = _Pieces(self._piece)
        self.agreeing: dict[tuple[bytes, bytes], bool] = {}

    # one piece ------------------------------------------------------------

    def _scanned(self, data: bytes) -> list[bytes]:
        """Merges of a short window: the lowest pair is searched among all."""
        rank = self.ranks.get
        cuts = list(range(len(data) + 1))
        costs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while costs and (low := min(costs)) != NEVER:
            i = costs.index(low)
            del costs[i], cuts[i + 1]
            if i:
                costs[i - 1] = rank(data[cuts[i - 1] : cuts[i + 1]], NEVER)
            if i < len(costs):
                costs[i] = rank(data[cuts[i] : cuts[i + 2]], NEVER)
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _heaped(self, data: bytes) -> list[bytes]:
        """Merges of a long window: (rank, place) of the pairs in a heap, parts as a linked list."""
        n, ranks = len(data), self.ranks
        ends, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\x01") * n
        while heap:
            _, i, middle, end = heapq.heappop(heap)
            if not alive[i] or ends[i] != middle or middle >= n or ends[middle] != end or not alive[middle]:
                continue
            j, k = after[i], after[middle]
            alive[j], ends[i], after[i] = 0, end, k
            if k < n:
                before[k] = i
                r = ranks.get(data[i : ends[k]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end, ends[k]))
            if before[i] >= 0:
                h = before[i]
                r = ranks.get(data[h:end])
                if r is not None:
                    heapq.heappush(heap, (r, h, i, end))
        parts, i = [], 0
        while i < n:
            parts.append(data[i : ends[i]])
            i = ends[i]
        return parts

    def _window(self, data: bytes) -> list[bytes]:
        return self._scanned(data) if len(data) <= SCANNED else self._heaped(data)

    def _agree(self, a: bytes, b: bytes) -> bool:
        """Whether two neighbouring tokens are the encoding of their bytes."""
        found = self.agreeing.get((a, b))
        if found is None:
            if len(self.agreeing) > CACHED_PIECES:
                self.agreeing.clear()
            found = self.agreeing[a, b] = self._window(a + b) == [a, b]
        return found

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left or right
        if self._agree(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            i, j = max(len(left) - reach, 0), min(reach, len(right))
            window = self._window(b"".join(left[i:]) + b"".join(right[:j]))
            starts = i == 0 or self._agree(left[i - 1], window[0])
            stops = j == len(right) or self._agree(window[-1], right[j])
            if starts and stops:
                return left[:i] + window + right[j:]
            reach *= 4

    def tree(self, data: bytes) -> list[bytes]:
        """Tokens of one piece by merges alone."""
        if len(data) <= self.piece_leaf:
            return self._window(data)
        middle = len(data) // 2
        return self.join_tokens(self.tree(data[:middle]), self.tree(data[middle:]))

    def _piece(self, data: bytes) -> bytes:
        """Ids of one piece; a piece that is a token is that token, whatever its merges give."""
        rank = self.ranks.get(data)
        return np.array([rank] if rank is not None else [self.ranks[t] for t in self.tree(data)], "<i4").tobytes()

    # texts ----------------------------------------------------------------

    def leaf(self, text: str, start: int, end: int) -> Segment:
        found = self.pattern.findall(text, start, end)
        ids = list(map(self.pieces.__getitem__, found))
        safe, open_bytes = end, 0
        while found and safe > end - LOOKAHEAD:
            safe -= len(found.pop())
            open_bytes += len(ids[len(found)])
        return Segment(start, end, b"".join(ids), safe, open_bytes)

    def join(self, text: str, left: Segment, right: Segment) -> Segment:
        """The segment of two neighbouring ones: what lies around their boundary is matched and encoded again."""
        end = right.end
        ours = (m.end() for m in self.pattern.finditer(text, left.safe, end))
        theirs = self.pattern.finditer(text, right.start, end)
        at, known, dropped = left.safe, right.start, 0
        made: list[bytes] = []
        places = [at]
        while at != known:
            if at < known:
                now = next(ours)
                made.append(self.pieces[text[at:now]])
                at = now
                places.append(at)
            else:
                piece = next(theirs)
                known = piece.end()
                dropped += len(self.pieces[piece.group()])
        ids = b"".join([left.ids[: len(left.ids) - left.open_bytes], *made, right.ids[dropped:]])
        if at <= right.safe <= end - LOOKAHEAD:
            return Segment(left.start, end, ids, right.safe, right.open_bytes)
        open_bytes = len(right.ids) - dropped
        while places[-1] > end - LOOKAHEAD and made:
            places.pop()
            open_bytes += len(made.pop())
        return Segment(left.start, end, ids, places[-1], open_bytes)

    def segment(self, text: str, start: int, end: int) -> Segment:
        if end - start <= self.text_leaf:
            return self.leaf(text, start, end)
        middle = (start + end) // 2
        return self.join(text, self.segment(text, start, middle), self.segment(text, middle, end))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian signed 32-bit numbers."""
        self.pieces.turn()
        return self.segment(text, 0, len(text)).ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids."""
        if len(ids) <= IDS_LEAF:
            return b"".join(map(self.tokens.__getitem__, ids.tolist()))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    """The coder of a Python worker, which keeps its pieces from task to task."""
    return ByteBpe(read_ranks(path), pattern)


def _id_lists(encoded: list[bytes]) -> pa.Array:
    ends = np.cumsum([0] + [len(x) // 4 for x in encoded])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(encoded), "<i4")))


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Return ``doc_id, ids array<int>`` of each row, without special tokens.

    A null text counts as empty and has no ids. Texts of any length are encoded
    whole; null ids and repeated rows are rows like any other; other columns are
    ignored; an empty table gives an empty result. No shuffle.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_bpe(path, pattern)
        for batch in batches:
            made, first, held = [], 0, 0

            def flush(upto: int, batch=batch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(first, upto - first), _id_lists(made)], ["doc_id", "ids"])

            for i in range(batch.num_rows):
                made.append(coder.encode(batch.column(1)[i].as_py() or ""))
                held += len(made[-1]) // 4
                if held >= BATCH_IDS:
                    yield flush(i + 1)
                    made, first, held = [], i + 1, 0
            if made:
                yield flush(batch.num_rows)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return with_text_batches(rows).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ids: str = "ids", name: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add the bytes of each row's ids; those of null are null. An id that the file lacks fails.

    Bytes need not be UTF-8 where ids were cut, so the column is binary.
    """
    path, pattern = path or default_path(), pattern or default_pattern()

    @F.arrow_udf("binary")
    def decoded(column: pa.Array) -> pa.Array:
        coder = byte_bpe(path, pattern)
        return pa.array([None if x is None else coder.decode(np.asarray(x.values)) if x.is_valid else None for x in column], pa.binary())

    return with_text_batches(encoded).withColumn(name, decoded(F.col(ids)))


def coded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the round trip of each row."""
    rows = decode_ids(encode_texts(docs, doc_id, text))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
