"""Held-out test items in training documents, by Wu-Manber search over words."""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, functions as F

from ..operators.cow import Files
from ..operators.shared import scratch
from .text import SINGLES
from .tokenize import ASTRAL, BMP, _ranges

LENGTH = 20  # words of a passage
BLOCK = 2  # words of a block
TABLE_CHARS = 16_000_000  # text of items in one set of tables: 100 MB of a worker on patents, some 500 where no two words meet twice; more items make several sets


@lru_cache(2)
def _forms(top: int) -> tuple[re.Pattern, re.Pattern]:
    own = "".join(f"{chr(a)}-{chr(b)}" for a, b in SINGLES)
    single = re.compile(f"[{own}]")
    other = _ranges("LN", top, lambda c: single.match(c) is not None)
    hidden = "".join(chr(i) for i in range(top + 1) if unicodedata.category(chr(i)) == "Cf")
    return re.compile(f"[{other}]+|[{own}]"), re.compile(f"[{re.escape(hidden)}]")


_ASCII = re.compile("[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """NFKC, no characters of category Cf, lower case; then the longest runs of letters and digits, but each kana or han character by itself."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = unicodedata.normalize("NFKC", text)
    word, hidden = _forms(sys.maxunicode if ASTRAL.search(text) else BMP)
    return word.findall(hidden.sub("", text).lower())


class Tables:
    """Shift table over blocks of words, and passages in buckets by their last block.

    The items' words are numbered and kept once, one after another, as an array of integers; a passage is the place of its
    first word. In its bucket passages are sorted by a hash, so one that is met is found by bisection however full the
    bucket is, and then compared word by word. See ``TABLE_CHARS`` for what this takes.
    """

    def __init__(self, items: list[tuple[int, str | None]], length: int = LENGTH):
        self.length = length
        self.number: dict[str, int] = {}
        self.words, self.starts, self.ids = array("i"), array("q"), []
        self.shift: dict[int, int] = {}  # block to how far it is at least from a passage's end, or for one that ends some to -1 - its bucket
        blocks, places = array("q"), array("q")
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number)) for x in words(text)]
            if len(w) < length:
                continue
            base = len(self.words)
            self.starts.append(base)
            self.ids.append(item)
            self.words.extend(w)
            for j in range(BLOCK, len(w) + 1):
                block = w[j - 2] << 32 | w[j - 1]
                if j >= length:
                    self.shift[block] = 0
                    blocks.append(block)
                    places.append(base + j - length)
                elif self.shift.get(block, length) > length - j:
                    self.shift[block] = length - j
        kept = memoryview(self.words)
        hashes = np.fromiter((hash(kept[p : p + length].tobytes()) for p in places), np.int64, len(places))
        blocks, places = np.frombuffer(blocks, np.int64), np.frombuffer(places, np.int64)
        order = np.lexsort((hashes, blocks))
        self.hashes, self.places = array("q", hashes[order].tobytes()), array("q", places[order].tobytes())
        edges = np.flatnonzero(np.diff(blocks[order], prepend=-1))
        self.edges = array("q", np.append(edges, len(places)).astype(np.int64).tobytes())
        for k, block in enumerate(blocks[order][edges].tolist()):
            self.shift[block] = -1 - k

    def item(self, place: int) -> int:
        return self.ids[bisect_right(self.starts, place) - 1]

    def search(self, w: list[str]) -> set[int]:
        """The items of which a passage stands in the words ``w``.

        A block that no passage has, and a word that no item has, lets the window jump past it; a block that ends passages
        names the bucket in which the window is looked up.
        """
        found: set[int] = set()
        length, shift, number = self.length, self.shift.get, self.number.get
        far, i = length - BLOCK + 1, length
        n = [number(x, -1) for x in w]
        while i <= len(n):
            a, b = n[i - 2], n[i - 1]
            step = length if b < 0 else far if a < 0 else shift(a << 32 | b, far)
            if step < 0:
                window = array("i", n[i - length : i])
                h, end = hash(window.tobytes()), self.edges[-step]
                k = bisect_left(self.hashes, h, self.edges[-1 - step], end)
                while k < end and self.hashes[k] == h:
                    place = self.places[k]
                    if self.words[place : place + length] == window:
                        found.add(self.item(place))
                    k += 1
                step = 1
            i += step
        return found


_made: dict[tuple, Tables] = {}


def _tables(path: str, length: int) -> Tables:
    """The tables of the items in a folder of Parquet files, made by a worker when it first needs them; it holds one set."""
    key = (path, length)
    if key not in _made:
        _made.clear()
        store, at = pafs.FileSystem.from_uri(path)
        files = sorted(x.path for x in store.get_file_info(pafs.FileSelector(at)) if x.path.endswith(".parquet"))
        _made[key] = Tables([(r["item_id"], r["text"]) for f in files for r in pq.read_table(f, filesystem=store).to_pylist()], length)
    return _made[key]


def leaks(documents: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, item_id), distinct: ``length`` consecutive words of the item also stand consecutively in the document.

    Items are the stated query set. They are written to the shared folder in as many sets as keep the text of a set under
    some ``TABLE_CHARS``, and each worker makes its tables from there; items never come to the driver and go with no task.
    Each set is searched in all documents, which stream through whole and aren't shuffled. Null, empty and short texts
    leak nothing; rows with a null id are left out; an item_id or doc_id with several rows leaks if one of them does.
    """
    spark = documents.sparkSession
    wanted = items.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    sets = max(1, -(-(wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // TABLE_CHARS))
    root = scratch(spark, "items")
    wanted.withColumn("set", F.pmod(F.xxhash64("item_id", "text"), F.lit(sets))).repartition(sets, "set").write.partitionBy("set").parquet(root)
    files = Files(spark, root)
    out = None
    for name in [n for n in files.names(root) if n.startswith("set=")]:
        path = files.fs.makeQualified(files.path(f"{root}/{name}")).toString().replace("file:/", "file:///", 1) if root.startswith("file:") else f"{root}/{name}"

        def work(batches, path=path):
            tables = _tables(path, length)
            for batch in batches:
                docs, hits = [], []
                for doc, text in zip(batch.column(0), batch.column(1)):
                    found = tables.search(words(text.as_py()))
                    if found:
                        docs += [doc.as_py()] * len(found)
                        hits += sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        one = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(work, "doc_id bigint, item_id bigint")
        out = one if out is None else out.unionAll(one)
    if out is None:
        return spark.createDataFrame([], "doc_id bigint, item_id bigint")
    return out.distinct()
