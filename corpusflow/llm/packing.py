"""Cost-balanced packing of token sequences.

Every text is tokenised and closed by an end id. Full-length slices of long
documents become sequences of their own; what remains is assigned, longest
first, to the open sequence of least estimated cost (linear plus quadratic
attention cost over its pieces) that has room, and is cut only where no
sequence can hold it whole. Each buffer of documents opens exactly as many
sequences as its ids fill: the last ids of a buffer go to sequences whose
capacities are the powers of two that add up to them, so nothing is padded.

Nothing is shuffled: a buffer is a bounded run of rows of one input partition
(``buffer_tokens``), so memory is bounded and a lost task is simply run again
with the same result. Null and empty texts are one end id; repeated rows are
packed one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Packing:
    tokenizer_path: str
    capacity: int = 2048
    end_id: int = 1
    #: estimated cost of a piece of n ids: linear * n + quadratic * n * n
    linear: float = 1.0
    quadratic: float = 1.0 / 2048
    #: ids gathered before a buffer is packed, and words kept in the tokenizer's cache
    buffer_tokens: int = 1 << 20
    cache_words: int = 750_000


class Tokens(dict):
    """Ids of whole texts, as little-endian bytes; itself the cache from words to ids.

    The tokenizer never joins what white space parts, so the ids of a text are
    those of its white-space words. Texts with characters for which case,
    normal form or white space could differ between libraries, or that hold a
    special token, go to the tokenizer whole.
    """

    plain = re.compile(r"[^\t\n\r -~¡-ɏ‐-…€]")

    def __init__(self, path: str, room: int) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tok, self.room = Tokenizer.from_file(path), room
        self.special = [x.content for x in self.tok.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        # symbols behind the last letter or digit are a piece of their own
        end = len(word)
        while end and not word[end - 1].isalnum():
            end -= 1
        out = self[word[:end]] + self[word[end:]] if 0 < end < len(word) else self.ids(word)
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if self.plain.search(text) or any(s in text for s in self.special):
            return self.ids(text)
        if len(self) > self.room:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


@cache
def _tokens(path: str, room: int) -> Tokens:
    """One for each Python worker, which runs many tasks."""
    return Tokens(path, room)


def assign(lengths: list[int], p: Packing) -> list[list[tuple[int, int, int, int]]]:
    """Per document its pieces (start, length, sequence, offset); sequences count from 0."""
    cap, n_seq = p.capacity, 0
    out: list[list[tuple[int, int, int, int]]] = []
    rest: list[tuple[int, int, int]] = []
    for i, n in enumerate(lengths):
        full, tail = divmod(n, cap)
        out.append([(k * cap, cap, n_seq + k, 0) for k in range(full)])
        n_seq += full
        if tail:
            rest.append((-tail, i, full * cap))
    total = -sum(r[0] for r in rest)
    sizes = [cap] * (total // cap) + [1 << b for b in range(cap.bit_length(), -1, -1) if (total % cap) >> b & 1]
    free, cost, used = np.array(sizes, np.int64), np.zeros(len(sizes)), np.zeros(len(sizes), np.int64)
    heapq.heapify(rest)
    while rest:
        n, i, start = heapq.heappop(rest)
        n = -n
        s = int(np.where(free >= n, cost, np.inf).argmin())
        if free[s] < n:  # no sequence holds it whole: it is cut
            s = int(np.where(free > 0, cost, np.inf).argmin())
            heapq.heappush(rest, (-(n - int(free[s])), i, start + int(free[s])))
            n = int(free[s])
        out[i].append((start, n, n_seq + s, int(used[s])))
        free[s] -= n
        used[s] += n
        cost[s] += p.linear * n + p.quadratic * n * n
    return out


def _packed(batches: Iterator[pa.RecordBatch], p: Packing) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ctx = TaskContext.get()
    base = (ctx.partitionId() if ctx else 0) << 32
    tokens, names = _tokens(p.tokenizer_path, p.cache_words), [x.split()[0] for x in SCHEMA.split(", ")]
    ids: list[int] = []
    held: list[np.ndarray] = []
    n_held, end = 0, array("I", [p.end_id]).tobytes()

    def flush() -> pa.RecordBatch:
        nonlocal base, n_held
        rows, top = [], -1
        for doc, t, pieces in zip(ids, held, assign([len(t) for t in held], p), strict=True):
            for start, n, seq, off in pieces:
                rows.append((doc, start, n, zlib.crc32(t[start : start + n].tobytes()), len(t), base + seq, off))
                top = max(top, seq)
        base += top + 1
        ids.clear()
        held.clear()
        n_held = 0
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                ids.append(doc)
                held.append(np.frombuffer(tokens.encode(text or "") + end, "<u4"))
                n_held += len(held[-1])
            if n_held >= p.buffer_tokens:
                yield flush()
    if ids:
        yield flush()


def pack(docs: DataFrame, p: Packing, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return docs.select("doc_id", text).mapInArrow(lambda b: _packed(b, p), SCHEMA)
