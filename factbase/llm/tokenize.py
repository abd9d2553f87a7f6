"""Byte-pair encoding of a whole corpus by a public vocabulary of merge ranks."""

from __future__ import annotations

import base64
import heapq
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

CACHE = 500_000  # distinct pieces kept by a worker; when full it starts afresh, which changes no result

# The endings that stand alone, and the characters of Unicode's White_Space property.
ENDINGS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary(path: str | None = None) -> bytes:
    """The file of ranks (base64 of the bytes, a blank, the rank); by default byte_bpe_50k of the installed tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


BMP = 0xFFFF
ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _ranges(majors: str, top: int, but: Callable[[str], bool] = lambda c: False) -> str:
    """A character class of all characters up to ``top`` whose category begins with one of ``majors``, without those that ``but`` names."""
    out, begin, last = [], None, None
    for i in range(top + 1):
        if unicodedata.category(chr(i))[0] in majors and not but(chr(i)):
            if begin is None:
                begin = i
            last = i
        elif begin is not None:
            out.append((begin, last))
            begin = None
    if begin is not None:
        out.append((begin, last))
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(2)
def pieces(top: int) -> re.Pattern:
    """How a text falls into pieces, which are encoded one by one: every character is in exactly one.

    For a text without characters above ``top``, as a class of BMP characters is matched much faster.
    """
    letter, number = _ranges("L", top), _ranges("N", top)
    space = "".join(f"\\U{ord(c):08x}" for c in SPACE)
    return re.compile("|".join([*ENDINGS, f" ?[{letter}]+", f" ?[{number}]+", f" ?[^{space}{letter}{number}]+", f"[{space}]+(?![^{space}])", f"[{space}]+"]))


class Encoder(dict):
    """Piece to ids, filled as pieces are met."""

    def __init__(self, ranks: bytes):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.bytes = {i: b for b, i in self.ranks.items()}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        ids = self[piece] = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Symbols in a doubly linked list and a heap of the ranks of adjacent pairs, least and leftmost first.

        A pair whose symbols have been merged since is stale and is passed over, so a piece of n bytes takes n log n
        steps however long it is.
        """
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, x) for i in range(n - 1) if (r := ranks.get(x := piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if symbol[i] is None or (j := after[i]) == n or symbol[i] + symbol[j] != pair:
                continue
            symbol[i], symbol[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(x := pair + symbol[k])) is not None:
                    heapq.heappush(heap, (r, i, x))
            if (h := before[i]) >= 0 and (r := ranks.get(x := symbol[h] + pair)) is not None:
                heapq.heappush(heap, (r, h, x))
        return [ranks[s] for s in symbol if s is not None]

    def encode(self, text: str | None):
        return chain.from_iterable(map(self.__getitem__, pieces(sys.maxunicode if ASTRAL.search(text) else BMP).findall(text))) if text else ()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_made: dict[int, Encoder] = {}


def _encoder(ranks: bytes) -> Encoder:
    key = hash(ranks)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(ranks)
    return _made[key]


def encoded(documents: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """(doc_id, ids): one row per row of documents, in any order. Null and empty text: the empty list; blanks are text.

    Special tokens are never made: their strings are ordinary text. The vocabulary, a file of fixed size, goes with the
    task; texts stream through in Arrow batches without a shuffle. A repeated doc_id keeps its rows; a text of any
    length is encoded whole.
    """
    ranks = vocabulary() if ranks is None else ranks

    def work(batches):
        encoder = _encoder(ranks)
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for text in batch.column(1):
                flat.extend(encoder.encode(text.as_py()))
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, ranks: bytes | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    ranks = vocabulary() if ranks is None else ranks

    def work(batches):
        encoder = _encoder(ranks)
        for batch in batches:
            texts = [encoder.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")
