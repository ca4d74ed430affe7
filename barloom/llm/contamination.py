"""Benchmark items inside documents, by size-partitioned MinHash containment search.

An item is contained in a document when the document holds at least ``num`` /
``den`` of the item's distinct word shingles, wherever they stand.

The MinHash sketch of an item is its smallest shingle hashes: one more than may be missing,
so a document that contains the item holds at least one of them, whatever its length.
(Banded MinHash signatures of whole documents would miss short items: an item of
50 shingles in a document of 20 000 has a Jaccard similarity of 0.0025.) Documents fall
into size classes, powers of two; each class is searched with the sketches of those items
that a document of the class can hold. Every candidate is then verified with the
exact sets. Items are taken in blocks of bounded size, each against all documents.

An item of fewer words than a shingle is one shingle of its own width; the documents are
searched in each width that an item has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.words import batch_word_hashes, shingle_set, shingles, text_slices
from barloom.session import materialize

#: Item shingles that are sent to the tasks at once.
BLOCK_SHINGLES = 1 << 20


class ItemIndex:
    """Sketches per size class and exact sets of one block of items of one shingle width."""

    def __init__(self, items: list[tuple[int, np.ndarray]], num: int, den: int):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.need = [-((-num * len(s)) // den) for s in self.sets]
        self.classes = max((n.bit_length() for n in self.need), default=0)
        self.tables = [self._table(c) for c in range(self.classes + 1)]

    def _table(self, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        fits = [i for i, n in enumerate(self.need) if n < 1 << size_class]
        sketch = [self.sets[i][: len(self.sets[i]) - self.need[i] + 1] for i in fits]
        if not sketch:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        keys = np.concatenate(sketch)
        owner = np.repeat(fits, [len(s) for s in sketch])
        order = np.argsort(keys, kind="stable")
        return keys[order], owner[order]

    def search(self, found: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, item size, shared) of all items contained in a document's shingles."""
        keys, owner = self.tables[min(len(found).bit_length(), self.classes)]
        if not len(keys):
            return []
        at = np.searchsorted(keys, found)
        hits = found[keys[np.minimum(at, len(keys) - 1)] == found]
        if not len(hits):
            return []
        first, last = np.searchsorted(keys, hits, "left"), np.searchsorted(keys, hits, "right")
        candidates = np.unique(np.concatenate([owner[a:b] for a, b in zip(first, last)]))
        whole = np.unique(found)
        out = []
        for i in candidates:
            item = self.sets[i]
            place = np.minimum(np.searchsorted(whole, item), len(whole) - 1)
            shared = int((whole[place] == item).sum())
            if shared >= self.need[i]:
                out.append((self.ids[i], len(item), shared))
        return out


def _item_sets(items: DataFrame, width: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            words = batch_word_hashes(frame["text"])
            sets = [shingle_set(w, width) for w in words]
            widths = [min(len(w), width) for w in words]
            sizes, keys = [len(s) for s in sets], [s.tobytes() for s in sets]
            yield pd.DataFrame({"item": frame["item"].to_numpy(), "width": widths, "n": sizes, "keys": keys})

    return items.mapInPandas(run, "item bigint, width int, n bigint, keys binary").where("n > 0").distinct()


def find_contained(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """(``id_col``, ``item_col``, item_shingles, shared_shingles) of every contained item.

    Shingles are ``width`` words with A-Z lowered; an item of fewer words is one shingle
    as a whole, contained in a document that has these words in a row. Null and empty items or documents contain nothing and are contained in
    nothing; rows without an id are left out. Repeated documents give repeated rows; items that repeat id
    and shingles count once. Empty tables give no rows. Other columns are ignored.
    """
    if not 0 < num <= den:
        raise ValueError("the containment lies in (0, 1]")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    named = items.select(F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("text"))
    sets = _item_sets(named.where("item is not null"), width)
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-total // block_shingles))
    out = None
    for block in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item", "keys"), F.lit(blocks)) == block).orderBy("item", "keys").collect()
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in rows:
            by_width.setdefault(r.width, []).append((r.item, np.frombuffer(r.keys, dtype=np.uint64)))
        index = {k: ItemIndex(some, num, den) for k, some in sorted(by_width.items())}
        found = _search(texts, spark.sparkContext.broadcast(index))
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"doc": id_col, "item": item_col})


def _search(texts: DataFrame, shared) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for frame in text_slices(frames):
            rows = []
            for doc, words in zip(frame["doc"], batch_word_hashes(frame["text"])):
                for width, items in index.items():
                    if len(words) >= width:
                        rows += [(doc, *hit) for hit in items.search(shingles(words, width))]
            if rows:
                yield pd.DataFrame(rows, columns=["doc", "item", "item_shingles", "shared_shingles"])

    return texts.mapInPandas(run, "doc bigint, item bigint, item_shingles bigint, shared_shingles bigint")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is contained, as they are; rows without an id stay."""
    hits = find_contained(docs, items, id_col=id_col, **options).select(F.col(id_col).alias("_hit")).distinct()
    hits = materialize(hits, "contaminated")  # few ids are broadcast by their measured size
    return docs.join(hits, docs[id_col] == hits["_hit"], "left_anti")
