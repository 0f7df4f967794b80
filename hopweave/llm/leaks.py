"""Evaluation passages inside training texts, by winnowing.

Both sides are folded to plain words (see ``normal``). Fingerprints are hashes of ``K``
successive words; of each window of ``WINDOW`` successive fingerprints the smallest is kept,
so any exact run of ``K + WINDOW - 1`` words shared by two texts yields a common kept
fingerprint. Twenty words with two altered have an unaltered run of at least six, so with
``K = 5`` and ``WINDOW = 2`` every wanted case is met. Hits are extended word by word over
altered, added and lacking words, and the best stretch is measured.

The evaluation side is cut into shards of at most about ``SHARD_FINGERPRINTS`` fingerprints in
the shared folder; workers keep the shards they read (see ``shards``), and every text passes
every shard. The work is linear in the texts for each shard, whatever grams are common: a
gram that stands in every text only adds hits inside the text at hand. A stretch counts from
``least`` words with at most one in ``per_altered`` altered; words at its rim count as altered
where the item goes on. Items of equal words are searched once.

Null or empty texts hold nothing; texts of any length are read whole; repeated rows count
once; extra columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import normal, shards

K = 5
WINDOW = 2
SHARD_FINGERPRINTS = 1_000_000
CHUNK_CHARS = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hash(word: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def grams(codes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` word codes."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest hash of each window (the rightmost of equals)."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    if n < window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


def _runs(doc: list, item: list, i: int, j: int) -> list[tuple[int, int, int]]:
    """Equal runs ``(doc place, item place, length)`` of an alignment through the equal words at ``i, j``."""

    def walk(a: int, b: int, step: int) -> list[tuple[int, int, int]]:
        out, n, m = [], len(doc), len(item)
        ok = lambda x, y: 0 <= x < n and 0 <= y < m and doc[x] == item[y]
        while True:
            start = b
            while ok(a, b):
                a, b = a + step, b + step
            if b != start:
                out.append((a, b, abs(b - start)))
            for da, db in ((1, 1), (1, 0), (0, 1), (2, 2), (1, 2), (2, 1), (2, 0), (0, 2), (3, 3)):
                x, y = a + da * step, b + db * step
                if ok(x, y) and (ok(x + step, y + step) or not (0 <= y + step < m and 0 <= x + step < n)):
                    a, b = x, y
                    break
            else:
                return out

    right = [(a - n, b - n, n) for a, b, n in walk(i, j, 1)]
    left = [(a + 1, b + 1, n) for a, b, n in walk(i - 1, j - 1, -1)]
    if left and right and left[0][0] + left[0][2] == right[0][0] and left[0][1] + left[0][2] == right[0][1]:
        right[0] = (left[0][0], left[0][1], left[0][2] + right[0][2])
        left = left[1:]
    return left[::-1] + right


def stretch(runs: list[tuple[int, int, int]], n_doc: int, n_item: int, per_altered: int = 10) -> tuple[int, int]:
    """Most item words, and how many of them altered, of a stretch with at most one in ``per_altered``."""
    best = (0, 0)
    for x in range(len(runs)):
        edits = 0
        for y in range(x, len(runs)):
            if y > x:
                a, b = runs[y - 1], runs[y]
                edits += max(b[0] - a[0] - a[2], b[1] - a[1] - a[2])
            first, last = runs[x][1], runs[y][1] + runs[y][2]
            size = last - first
            spare = size // (per_altered - 1) if not edits else (size - per_altered * edits) // (per_altered - 1)
            if size < per_altered * edits:
                continue
            # altered words at the rim, as far as both texts go on
            rim = min(first, runs[x][0]) + min(n_item - last, n_doc - runs[y][0] - runs[y][2])
            more = max(0, min(rim, spare))
            while more and (edits + more) * per_altered > size + more:
                more -= 1
            best = max(best, (size + more, -(edits + more)))
    return best[0], -best[1]


def best_stretch(doc: list, item: list, hits: list[tuple[int, int]], per_altered: int = 10) -> tuple[int, int]:
    best, seen = (0, 0), set()
    for i, j in sorted(hits):
        if (i, j) in seen:
            continue
        runs = _runs(doc, item, i, j)
        seen.update((a + s, b + s) for a, b, n in runs for s in range(n))
        if sum(n for _, _, n in runs) > best[0] * (per_altered - 1) // per_altered:
            best = max(best, stretch(runs, len(doc), len(item), per_altered))
    return best


class _Index:
    """Folded evaluation items with their kept fingerprints."""

    def __init__(self, ids: list, texts: list[list[str]]) -> None:
        same: dict[tuple, list] = {}
        for i, t in zip(ids, texts, strict=True):
            same.setdefault(tuple(t), []).append(i)
        self.ids, texts = list(same.values()), [list(t) for t in same]
        self.texts = texts
        vocabulary = sorted({w for t in texts for w in t})
        self.code = {w: i + 1 for i, w in enumerate(vocabulary)}
        hashes = np.array([0, *map(word_hash, vocabulary)], np.uint64)
        self.hashes = hashes
        h, item, place = [], [], []
        for n, t in enumerate(texts):
            g = grams(hashes[[self.code[w] for w in t]] if t else np.zeros(0, np.uint64))
            at = winnow(g)
            h.append(g[at])
            item += [n] * len(at)
            place += at.tolist()
        h = np.concatenate(h) if h else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.place = h[order], np.array(item, np.int64)[order] if item else np.zeros(0, np.int64), np.array(place, np.int64)[order] if item else np.zeros(0, np.int64)

    def hits(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, doc place, item place)`` of the kept fingerprints of word codes that are also kept here."""
        g = grams(self.hashes[codes])
        if not len(g) or not len(self.h):
            return []
        # a gram with a word that no item has lies in no shared run; it may not win a window
        bad = np.concatenate([[0], np.cumsum(codes == 0)])
        g[bad[K:] - bad[:-K] > 0] = _NONE
        at = winnow(g)
        at = at[g[at] != _NONE]
        lo, hi = np.searchsorted(self.h, g[at], "left"), np.searchsorted(self.h, g[at], "right")
        out = []
        for k in np.flatnonzero(hi > lo):
            out += [(int(self.item[x]), int(at[k]), int(self.place[x])) for x in range(lo[k], hi[k])]
        return out


def _leaks(index: _Index, doc: list[str], least: int, per_altered: int) -> list[tuple[object, int, int]]:
    if len(doc) < K:
        return []
    get = index.code.get
    codes = np.fromiter((get(w, 0) for w in doc), np.int64, len(doc))
    by: dict[int, list[tuple[int, int]]] = {}
    for n, i, j in index.hits(codes):
        by.setdefault(n, []).append((i, j))
    out = []
    for n, hits in by.items():
        words, altered = best_stretch(doc, index.texts[n], hits, per_altered)
        if words >= least:
            out += [(i, words, altered) for i in index.ids[n]]
    return out


def _build(found: list[dict]) -> _Index:
    return _Index([r["item_id"] for r in found], [normal.words(r["text"]) for r in found])


def find_leaks(docs: DataFrame, items: DataFrame, least: int = 20, per_altered: int = 10, shard_fingerprints: int = SHARD_FINGERPRINTS) -> DataFrame:
    """``doc_id, item_id, n_words, n_altered`` of documents that hold a passage of an item.

    ``docs`` has ``doc_id, text``; ``items`` has ``item_id, text``.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    items = items.select("item_id", "text").where("text is not null").distinct()
    docs = docs.select("doc_id", "text").where("text is not null")
    # a fingerprint needs at least one letter and a gap for each word, so characters bound their number
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    count = max(1, -(-chars // (2 * shard_fingerprints)))
    folder = shards.store(items.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(count)).cast("int")).repartition("shard"), "items")
    schema = T.StructType([docs.schema["doc_id"], items.schema["item_id"], T.StructField("n_words", T.IntegerType()), T.StructField("n_altered", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def passed(ids: list, texts: list[str]) -> Iterator[pa.RecordBatch]:
        folded = [normal.words(t) for t in texts]
        for n in range(count):
            index = shards.load(folder, n, _build)
            found = [(i, *x) for i, t in zip(ids, folded, strict=True) for x in _leaks(index, t, least, per_altered)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= (CHUNK_CHARS if count > 1 else 1_000_000):
                    yield from passed(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield from passed(ids, texts)

    return _strongest(docs.mapInArrow(run, schema))


def _strongest(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("n_words", (-F.col("n_altered")).alias("kept"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.kept")).alias("n_altered"))
