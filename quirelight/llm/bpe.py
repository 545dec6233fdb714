"""Problem 6: encode a corpus with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every byte prefix of a piece of text there is exactly one token that can end
a valid encoding of the prefix; ``PrefixBpe.last_tokens`` stores it. The ids of a piece are read backwards from the
stored tokens. Appending bytes keeps all earlier entries (``extend``), and after an edit only the entries from the
first changed byte on are computed again (``reencode``).

Defined results: null and empty texts give an empty list; strings that look like special tokens are plain text; the
text is never changed; rows with the same id come out as often as they went in; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the vocabulary's texts are split before merging (fixed value, published with the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of a worker's memo of words; a full memo is emptied, which costs time and changes no result.
MEMO = 400_000
#: Longer pieces are encoded without the memo.
MEMO_CHARS = 64


class PrefixBpe:
    """Byte-level BPE over a rank table (bytes -> id, ids in the order of the merges)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        lengths = sorted({len(t) for t in ranks}, reverse=True)
        #: Lengths of tokens that fit before an end, for the ends up to the longest token.
        self.fits = [[n for n in lengths if n <= end] for end in range(lengths[0] + 1)]
        self.joins: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE, lowest rank first, for short ``data``."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _follows(self, before: bytes | None, token: bytes) -> bool:
        """Whether ``token`` may stand after ``before`` (or at the start): the merges of the two together keep both."""
        t = self.ranks[token]
        if before is None:
            if t not in self.alone:
                self.alone[t] = self.merge(token) == [t]
            return self.alone[t]
        key = (self.ranks[before], t)
        if (known := self.joins.get(key)) is None:
            if len(self.joins) > 2_000_000:
                self.joins.clear()
            known = self.joins[key] = self.merge(before + token) == [key[0], t]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Carry the table on: ``last[k]`` is the length of the last token of ``data[:k + 1]``; entries already there are kept."""
        ranks, fits, most = self.ranks, self.fits, len(self.fits) - 1
        for end in range(len(last) + 1, len(data) + 1):
            for n in fits[min(end, most)]:
                token = data[end - n : end]
                if token not in ranks:
                    continue
                at = end - n
                if self._follows(data[at - last[at - 1] : at] if at else None, token):
                    last.append(n)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return last

    def last_tokens(self, data: bytes) -> list[int]:
        return self.extend(data, [])

    def read_back(self, data: bytes, last: list[int]) -> list[int]:
        ids, end = [], len(data)
        while end:
            n = last[end - 1]
            ids.append(self.ranks[data[end - n : end]])
            end -= n
        return ids[::-1]

    def piece(self, data: bytes) -> list[int]:
        if data in self.ranks and self._follows(None, data):  # the whole piece is its own last token
            return [self.ranks[data]]
        return self.read_back(data, self.last_tokens(data))

    def reencode(self, old: bytes, last: list[int], new: bytes) -> tuple[list[int], list[int]]:
        """The table and the ids of ``new``, taking over ``old``'s entries up to the first byte that differs."""
        same = len(os.path.commonprefix([old, new]))
        table = self.extend(new, last[:same])
        return table, self.read_back(new, table)


class _Memo(dict):
    """Words (with the blank before them) to ids."""

    def __init__(self, bpe: PrefixBpe):
        super().__init__()
        self.bpe, self.split = bpe, regex.compile(PATTERN).findall
        self.pieces: dict[str, list[int]] = {}

    def __missing__(self, words: str) -> tuple[int, ...]:
        ids: list[int] = []
        pieces = self.pieces
        for p in self.split(words):
            if (known := pieces.get(p)) is None:
                known = self.bpe.piece(p.encode("utf-8", "surrogatepass"))
                if len(p) <= MEMO_CHARS:
                    if len(pieces) >= MEMO:
                        pieces.clear()
                    pieces[p] = known
            ids += known
        if len(words) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[words] = tuple(ids)
        return ids


#: A blank, or a line feed, between two characters that aren't white space always begins a piece, and a piece begins
#: after such a line feed: texts are cut there first, so that the memo holds words and not pairs around line ends.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s \s|^ | $")


def encode_text(text: str | None, memo: _Memo) -> list[int]:
    """Ids of one text; empty for null and empty texts."""
    if not text:
        return []
    keys: list[str] = []
    run: list[str] = []  # lines that can't be parted
    for line in text.split("\n"):
        if run and line and run[-1] and not line[0].isspace() and not run[-1][-1].isspace():
            _words("\n".join(run), keys)
            keys.append("\n")
            run = []
        run.append(line)
    _words("\n".join(run), keys)
    return list(chain.from_iterable(map(memo.__getitem__, keys)))


def _words(run: str, keys: list[str]) -> None:
    parts = _CUT.split(run) if _ODD.search(run) else run.split(" ")
    keys.append(parts[0])
    keys.extend([" " + p for p in parts[1:]])


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: base64 token, blank, id on each line."""
    return {base64.b64decode(t): int(n) for t, n in map(bytes.split, raw.splitlines()) if t}


_LOADED: dict[int, _Memo] = {}


def encode_corpus(documents: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of every row. The rank file (under 1 MB, read by the driver) reaches the workers by broadcast; no shuffle."""
    raw = open(ranks_file, "rb").read()
    shared = documents.sparkSession.sparkContext.broadcast(raw)
    key = hash(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _LOADED.get(key)
        if memo is None:
            memo = _LOADED[key] = _Memo(PrefixBpe(parse_ranks(shared.value)))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [encode_text(t, memo) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [id_col, "ids"])

    source = documents.select(F.col(id_col), F.col(text_col).cast("string"))
    return source.mapInArrow(run, f"`{id_col}` {source.schema[0].dataType.simpleString()}, ids array<int>")
