"""Hierarchical multi-length packing of token sequences.

A map over the scan, no shuffle: each task packs the documents it reads, window by window of
``BUFFER_TOKENS`` tokens, so memory is bounded however long a document or a partition is.

* Routing: a document gives whole windows of the longest tier; its rest goes to the shortest tier
  that holds it.
* Packing: each tier opens its sequences with its own pieces, longest first; gaps of the longest
  windows are filled from shorter tiers, best fit first. Sequences of shorter tiers are filled
  exactly: the last piece is cut and its rest goes back to the tier that suits it.
* Step groups: sequences of one tier, ``step_tokens`` tokens together, so that every group costs the
  same number of tokens.
* What is left at the end of a task is cut into sequences of lengths that are powers of two; groups not
  full by then are dealt anew over all lengths, so that all but one of a task's groups are full or nearly so.
"""

from __future__ import annotations

import bisect
import functools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import PLAIN, load_ranks
from .common import id_text

TIERS = (256, 512, 1024, 2048)
#: Tokens that a task holds before it packs them.
BUFFER_TOKENS = 1 << 20
#: A gap up to this many tokens in a longest window is left as padding rather than cutting a document.
SMALL_GAP = 8
#: Sequence and step-group ids: task number times this, plus a count within the task.
IDS_PER_TASK = 1 << 32
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@functools.cache
def fast_encoder(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Ids as the tokenizer file gives them; plain text by the rank file of the same vocabulary, which gives the same ids faster."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(json_path) as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    # few texts need it, and it is large: loaded with the first of them
    slow = functools.cache(lambda: Tokenizer.from_file(json_path))
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(ranks_path), special_tokens={})

    def encode(text: str) -> np.ndarray:
        if PLAIN.fullmatch(text) and not any(s in text for s in special):
            return np.array(fast.encode_ordinary(text), np.uint32)
        return np.array(slow().encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


class Packer:
    """Pools of pieces by tier; a piece is (length, arrival, document, start, ids)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.pools: list[list] = [[] for _ in tiers]
        self.held = self.arrivals = 0
        self.next_sequence = self.next_group = task * IDS_PER_TASK
        self.open: dict[int, list[list[tuple]]] = {}  # sequences of each length that wait for their group

    def _route(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        if len(ids):
            pool = self.pools[bisect.bisect_left(self.tiers, len(ids))]
            self.arrivals += 1
            bisect.insort(pool, (len(ids), self.arrivals, doc, start, ids))
            self.held += len(ids)

    def _take(self, pool: int, at: int) -> tuple:
        piece = self.pools[pool].pop(at)
        self.held -= piece[0]
        return piece

    def _emit(self, size: int, pieces: list[tuple]) -> Iterator[tuple]:
        rows, offset = [], 0
        for length, _, doc, start, ids in pieces:
            rows.append((*doc[:1], start, length, ids.tobytes(), doc[1], self.next_sequence, offset, size))
            offset += length
        self.next_sequence += 1
        waiting = self.open.setdefault(size, [])
        waiting.append(rows)
        if (len(waiting) + 1) * size > self.step_tokens:
            yield from self._group(self.open.pop(size))

    def _group(self, sequences: list[list[tuple]]) -> Iterator[tuple]:
        for rows in sequences:
            yield from ((*row, self.next_group) for row in rows)
        self.next_group += 1

    def _last_groups(self) -> Iterator[tuple]:
        """Sequences of groups that did not fill, longest first into the first group with room."""
        groups: list[tuple[int, list]] = []
        for size in sorted(self.open, reverse=True):
            for rows in self.open[size]:
                at = next((i for i, (held, _) in enumerate(groups) if held + size <= self.step_tokens), len(groups))
                if at == len(groups):
                    groups.append((0, []))
                groups[at] = groups[at][0] + size, [*groups[at][1], rows]
        self.open = {}
        for _, sequences in groups:
            yield from self._group(sequences)

    def add(self, doc_id: object, ids: np.ndarray) -> Iterator[tuple]:
        doc, top, start = (doc_id, len(ids)), self.tiers[-1], 0
        while len(ids) - start >= top:
            yield from self._emit(top, [(top, 0, doc, start, ids[start : start + top])])
            start += top
        self._route(doc, start, ids[start:])

    def _best(self, gap: int, below: int) -> tuple | None:
        """The longest piece that fits, of the pools below the given one."""
        for pool in range(below - 1, -1, -1):
            at = bisect.bisect_right(self.pools[pool], gap, key=lambda p: p[0]) - 1
            if at >= 0:
                return self._take(pool, at)
        return None

    def _cut(self, gap: int) -> tuple | None:
        """The head of a piece that is longer than the gap, the shortest such; its rest is routed anew."""
        for pool in self.pools:
            at = bisect.bisect_right(pool, gap, key=lambda p: p[0])
            if at < len(pool):
                length, n, doc, start, ids = pool.pop(at)
                self.held -= length
                self._route(doc, start + gap, ids[gap:])
                return gap, n, doc, start, ids[:gap]
        return None

    def pack(self, last: bool = False) -> Iterator[tuple]:
        """Sequences from the pools, tier by tier from the longest; what cannot fill one waits, or goes at the end of the task."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.pools[tier]:
                if self.held < size:
                    break
                pieces = [self._take(tier, -1)]
                gap = size - pieces[0][0]
                while gap and (piece := self._best(gap, tier + 1)):
                    pieces.append(piece)
                    gap -= piece[0]
                if gap > (SMALL_GAP if size == self.tiers[-1] else 0) and (piece := self._cut(gap)):
                    pieces.append(piece)
                    gap -= piece[0]
                if gap and size != self.tiers[-1]:  # nothing is left to fill it: wait, or flush below
                    for length, _, doc, start, ids in pieces:
                        self._route(doc, start, ids)
                    break
                yield from self._emit(size, pieces)
        if last:
            rest = [self._take(pool, -1) for pool in range(len(self.pools)) for _ in range(len(self.pools[pool]))]
            total = sum(p[0] for p in rest)
            while total:
                size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
                gap, pieces = size, []
                while gap:
                    length, n, doc, start, ids = rest.pop()
                    if length > gap:
                        rest.append((length - gap, n, doc, start + gap, ids[gap:]))
                        length, ids = gap, ids[:gap]
                    pieces.append((length, n, doc, start, ids))
                    gap -= length
                total -= size
                yield from self._emit(size, pieces)
            yield from self._last_groups()


def packed(
    docs: DataFrame, encode: Callable[[], Callable[[str], np.ndarray]], *, release: Callable[[], None] | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 1 << 16
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, tier, step_group.

    ``encode()`` is called once in a task and returns text -> ids; ``release()`` is called at its end, so
    that workers that Spark uses again do not hold the tables. A document's ids are those of its text and
    then ``end_id``; each lies in exactly one piece.

    Defined cases: null and empty texts are the single id ``end_id``; null and repeated doc_ids are
    separate documents; documents of any length are cut into windows; an empty table gives an empty
    result; other columns are ignored.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, packer, schema = encode(), Packer(TaskContext.get().partitionId(), tiers, step_tokens), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [schema, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))])

        rows: list[tuple] = []
        for batch in batches:
            schema = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.extend(packer.add(doc_id, np.append(to_ids(text.as_py()), np.uint32(end_id))))
                if packer.held >= BUFFER_TOKENS:
                    rows.extend(packer.pack())
                if len(rows) >= 2000:
                    yield table(rows)
                    rows = []
        if release:
            del to_ids
            release()
        rows.extend(packer.pack())
        rows.extend(packer.pack(last=True))
        if rows:
            yield table(rows)

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
