"""Byte-level BPE by prefix dynamic programming.

For each byte prefix of a piece exactly one token can end its encoding: a token that is a suffix of
the prefix and that BPE would leave standing next to the last token of what precedes it. Storing this
token per prefix gives the encoding (walk back), exact appends (go on from the last prefix) and
re-encoding near an edit (recompute until the stored tokens agree again).

``roundtrip`` is the operator: a map over the scan, no shuffle; each Python worker builds the tables
once and keeps a bounded memo of pieces.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text

#: Pieces that a worker remembers; the memo starts anew beyond that.
MEMO_PIECES = 600_000
#: Bytes of a piece's head whose table is remembered and appended to, and how many such heads.
HEAD, HEADS = 6, 300_000
#: Judged pairs of neighbours that are remembered.
PAIRS = 2_000_000
#: Characters for which the standard library's classes split as the Unicode classes of the pattern do.
PLAIN = re.compile(r"[\x00-\x1b\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-ſ]*")
#: White space as Unicode defines it (fixed values of that property).
WHITE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PrefixBPE:
    """Tables of one vocabulary: how each token came about, and which neighbours stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks, strict=True))
        self.longest = max(map(len, ranks))
        self.made_of: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.apart: dict[int, bool] = {}
        self.heads: dict[bytes, array] = {}
        # tokens by their bytes from the last to the first: (node * 256 + byte) to node, and the token there
        self.back: dict[int, int] = {}
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in reversed(token):
                step = node << 8 | byte
                node = self.back.get(step)
                if node is None:
                    node = self.back[step] = len(self.token_at)
                    self.token_at.append(-1)
            self.token_at[node] = rank
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self._apart(left, right):
                    self.merged[left, right], self.made_of[rank] = rank, (left, right)
                    break

    def _apart(self, left: int, right: int) -> bool:
        """Whether BPE on the joined bytes of two tokens ends in just these two.

        Undo merges from the latest on, on the side where it happened, and look at the two parts that
        touch at the border: a merge across it that comes before the one undone would have won.
        """
        bound = float("inf")
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            # of merges of equal rank the one further left comes first
            parts_l, parts_r = self.made_of.get(left), self.made_of.get(right)
            if parts_l and (left > right or not parts_r):
                bound, left = left, parts_l[1]
            elif parts_r:
                bound, right = right + 0.5, parts_r[0]
            else:
                return True

    def _remember(self, key: int, left: int, right: int) -> bool:
        if len(self.apart) > PAIRS:
            self.apart.clear()
        ok = self.apart[key] = self._apart(left, right)
        return ok

    def last_tokens(self, piece: bytes, known: array | None = None) -> array:
        """For each prefix length 1.. the last token of its encoding; ``known`` are those of a shorter prefix."""
        last = array("i", known or ())
        back, token_at, apart = self.back.get, self.token_at, self.apart.get
        for end in range(len(last), len(piece)):
            node, at, found = 0, end, []
            while at >= 0:
                node = back(node << 8 | piece[at])
                if node is None:
                    break
                if token_at[node] >= 0:
                    found.append((at, token_at[node]))
                at -= 1
            for at, token in reversed(found):
                if not at:
                    break
                key = last[at - 1] << 32 | token
                ok = apart(key)
                if ok is None:
                    ok = self._remember(key, last[at - 1], token)
                if ok:
                    break
            last.append(token)
        return last

    def walk(self, last: array) -> list[int]:
        out, end = [], len(last)
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(self.bytes_of[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        if token is not None:
            return [token]
        head, known = piece[:HEAD], None
        if len(piece) > HEAD:
            known = self.heads.get(head)
            if known is None:
                if len(self.heads) >= HEADS:
                    self.heads.clear()
                known = self.heads[head] = self.last_tokens(head)
        return self.walk(self.last_tokens(piece, known))

    def append(self, last: array, piece: bytes, more: bytes) -> array:
        """The table of ``piece + more`` from that of ``piece``."""
        return self.last_tokens(piece + more, last)

    def edit(self, last: array, piece: bytes, start: int, stop: int, new: bytes) -> tuple[bytes, array]:
        """The piece and table after ``piece[start:stop]`` became ``new``: recomputed from ``start`` until ``longest`` tokens in a row agree with the old ones."""
        whole, shift, same = piece[:start] + new + piece[stop:], len(new) - (stop - start), 0
        table = last[:start]
        while len(table) < len(whole):
            end = len(table) + 1
            table = self.last_tokens(whole[:end], table)
            old = end - shift
            # a token that reaches back into the edit may agree by chance, so only those after it count
            same = same + 1 if end > start + len(new) and last[old - 1] == table[-1] else 0
            if same >= self.longest:
                table.extend(last[old:])
        return whole, table

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Memo(dict):
    """piece (str) to its ids, packed as 32-bit integers; when full, one older generation stays in reach."""

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.older = bpe, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("i", self.bpe.encode_piece(piece.encode())).tobytes()
        if len(self) >= MEMO_PIECES // 2:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class TextEncoder:
    """Whole texts: each match of the pattern separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe = PrefixBPE(ranks)
        self.memo = _Memo(self.bpe)
        self.table = [self.bpe.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]
        white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")
        self.any = regex.compile(white).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d")
        self.plain = re.compile(plain).findall if r"\p" not in plain else self.any

    def split(self, text: str) -> list[str]:
        return (self.plain if PLAIN.fullmatch(text) else self.any)(text)

    def packed(self, text: str) -> bytes:
        return b"".join(map(self.memo.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))


@functools.cache
def encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(load_ranks(path), pattern)


def roundtrip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", rows: int = 64) -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded binary (the bytes that the ids stand for).

    Defined cases: null text counts as empty and has no ids; any doc_id passes through, null and
    repeated ones too; other columns are ignored. ``ranks_path`` must exist on every executor.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([enc.decode(x) for x in ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")
