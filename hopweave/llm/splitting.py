"""Cutting oversized texts at natural boundaries by structure-tree packing.

A text is parsed into a tree: sections by heading depth (``#``, underlined, ``<h1>`` to
``<h6>``), blocks (blank lines, fenced code, block tags), list items by nesting, lines,
sentences, words. Inside a fence nothing is a heading, an item or a blank line. A node within
the limit stays whole; only an oversized node is descended into, and neighbouring siblings
are merged bottom-up while they fit. Where not even a word fits, the cut is at a token. Each
piece but the first then starts earlier by about ``overlap`` tokens, at a sentence or else a
word start.

A text is encoded once; sizes of spans come from the running token offsets, and each piece
is encoded again to prove that it keeps the limit. Null and empty texts, and texts within
the limit, have no pieces. Rows are told apart by nothing: repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

_SENTENCE = re.compile(r"[.!?…。！？][\"'’”)\]]*\s+|[。！？]")
_WORD = re.compile(r"\s+")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]+\S")
_UNDER = re.compile(r" {0,3}(=|-)\1{2,}[ \t]*\r?$")
_ITEM = re.compile(r"([ \t]*)(?:[-*+•]|\d{1,9}[.)])[ \t]+\S")
_TAG = re.compile(r"<(/?)(h[1-6]|p|div|section|article|table|tr|ul|ol|li|blockquote|pre|hr)\b", re.I)
_LINE = re.compile(r"\n")
BLOCK, ITEM, LINE = 7, 8, 1000  # ranks of boundaries; sections have their depth, items add their nesting
FREE = ("sentence", "word", "token")
PIECES = "piece_index int, start_char long, end_char long, n_tokens int, end_kind string, piece string"


class _Sizes:
    """Tokens up to a character position of one text."""

    def __init__(self, text: str, path: str) -> None:
        e = tokens.encoder(path)
        ids = e.encode_ordinary(text)
        ends = np.cumsum([len(b) for b in e.decode_tokens_bytes(ids)]) if ids else np.zeros(0, np.int64)
        self.n = len(ids)
        if text.isascii():
            self.byte_of = None
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            self.byte_of = np.concatenate([[0], np.cumsum(width)])
        self.ends = ends

    def upto(self, char: int | np.ndarray):  # noqa: ANN201
        return np.searchsorted(self.ends, char if self.byte_of is None else self.byte_of[char], side="left") + (np.asarray(char) > 0)

    def char_at(self, token: int) -> int:
        """Last character position within the first ``token`` tokens."""
        if token <= 0 or not len(self.ends):
            return 0
        byte = int(self.ends[min(token, self.n) - 1])
        return byte if self.byte_of is None else int(np.searchsorted(self.byte_of, byte, side="right") - 1)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a node of the text's tree starts, and their ranks: the smaller, the higher in the tree."""
    at: dict[int, int] = {}

    def mark(place: int, rank: int) -> None:
        at[place] = min(rank, at.get(place, rank))

    lines, place = [], 0
    for x in text.split("\n"):
        lines.append((place, x))
        place += len(x) + 1
    fence, blank, nest = "", False, []
    for i, (place, x) in enumerate(lines):
        ticks = _FENCE.match(x)
        if fence:
            mark(place, LINE)
            if ticks and ticks[1].startswith(fence):
                fence = ""
                mark(min(place + len(x) + 1, len(text)), BLOCK)
            continue
        if not x.strip():
            blank = True
            continue
        indent = len(x) - len(x.lstrip())
        item, head = _ITEM.match(x), _HEAD.match(x)
        under = _UNDER.match(lines[i + 1][1]) if i + 1 < len(lines) and not item and not head else None
        if ticks:
            fence = ticks[1]
            mark(place, BLOCK)
        elif head or under:
            nest = []
            mark(place, len(head[1]) if head else 1 if under[1] == "=" else 2)
        elif item:
            deep = [n for n in nest if n < len(item[1].expandtabs())]
            first, nest = not nest, [*deep, len(item[1].expandtabs())]
            mark(place, BLOCK if first and blank else ITEM + len(deep))
        elif blank:
            nest = [n for n in nest if n < indent]
            mark(place, ITEM + len(nest) if nest else BLOCK)
        else:
            mark(place, LINE)
        blank = False
    if "<" in text:
        lists = 0
        for m in _TAG.finditer(text):
            name, shut = m[2].lower(), bool(m[1])
            lists += (name in ("ul", "ol")) * (-1 if shut else 1)
            if not shut:
                mark(m.start(), int(name[1]) if name[0] == "h" and name != "hr" else ITEM + max(0, lists - 1) if name == "li" else BLOCK)
    places = sorted(at)
    return np.array(places, np.int64), np.array([at[p] for p in places], np.int64)


def _kind(rank: int) -> str:
    return "section" if rank < BLOCK else "block" if rank == BLOCK else "item" if rank < LINE else "line"


class _Packer:
    def __init__(self, text: str, sizes: _Sizes, limit: int) -> None:
        self.text, self.sizes, self.limit = text, sizes, limit
        self.places, self.ranks = boundaries(text)

    def size(self, a: int, b: int) -> int:
        return int(self.sizes.upto(b) - self.sizes.upto(a)) + 1

    def tree(self, lo: int, hi: int, above: int = 0) -> list[tuple[int, int, str]]:
        """Pieces of a node: its children, those too large packed in turn; boundaries up to rank ``above`` count no more."""
        i, j = np.searchsorted(self.places, lo, "right"), np.searchsorted(self.places, hi, "left")
        ranks = self.ranks[i:j]
        ranks = ranks[ranks > above]
        if not len(ranks):
            return self.free(lo, hi, 0)
        top = int(ranks.min())
        cuts = self.places[i:j][self.ranks[i:j] == top].tolist()
        return self.packed([lo, *cuts, hi], _kind(top), lambda a, b: self.tree(a, b, top))

    def free(self, lo: int, hi: int, level: int) -> list[tuple[int, int, str]]:
        """Pieces of a line: sentences, words, tokens."""
        if FREE[level] == "token":
            out, at = [], lo
            while at < hi:
                end = min(hi, max(at + 1, self.sizes.char_at(int(self.sizes.upto(at)) + self.limit - 2)))
                out.append((at, end, "token"))
                at = end
            return out
        pattern = (_SENTENCE, _WORD)[level]
        cuts = [m.end() for m in pattern.finditer(self.text, lo, hi) if lo < m.end() < hi]
        if not cuts:
            return self.free(lo, hi, level + 1)
        return self.packed([lo, *cuts, hi], FREE[level], lambda a, b: self.free(a, b, level + 1))

    def packed(self, edges: list[int], kind: str, down: Callable[[int, int], list[tuple[int, int, str]]]) -> list[tuple[int, int, str]]:
        out: list[tuple[int, int, str]] = []
        at = self.sizes.upto(np.asarray(edges))
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            children = [(a, b, kind)]
            if at[i + 1] - at[i] + 1 > self.limit:
                children = down(a, b)
                children[-1] = (*children[-1][:2], kind)
            for c in children:  # merge with the sibling before while both fit
                if out and self.size(out[-1][0], c[1]) <= self.limit:
                    out[-1] = (out[-1][0], c[1], c[2])
                elif out and kind not in FREE and 4 * self.size(out[-1][0], out[-1][1]) < self.limit:
                    # a scrap (a heading, say) goes with what follows, which is cut lower down
                    again = down(out.pop()[0], c[1])
                    out += [*again[:-1], (*again[-1][:2], c[2])]
                else:
                    out.append(c)
        return out


def split_text(text: str | None, limit: int = 3000, overlap: int = 100, path: str = tokens.VOCABULARY) -> list[tuple[int, int, int, str]]:
    """Pieces ``(start, end, n_tokens, end_kind)`` of a text of more than ``limit`` tokens; none for others."""
    if not text or len(text) * 4 <= limit or len(text.encode("utf-8", "replace")) <= limit:
        return []
    text = text.encode("utf-8", "replace").decode("utf-8")
    sizes = _Sizes(text, path)
    if sizes.n <= limit:
        return []
    room = max(limit - overlap - overlap // 4 - 8, limit // 2, 1)
    count = lambda a, b: len(tokens.encoder(path).encode_ordinary(text[a:b]))
    out: list[tuple[int, int, int, str]] = []
    todo = _Packer(text, sizes, room).tree(0, len(text))[::-1]
    while todo:
        lo, hi, kind = todo.pop()
        if count(lo, hi) > limit:  # cutting inside a token can add tokens
            smaller = _Packer(text, sizes, max(1, room // 2)).free(lo, hi, 0)
            if len(smaller) > 1:
                todo += [*smaller[:-1], (*smaller[-1][:2], kind)][::-1]
                continue
        start = lo
        if out and overlap:
            start = _overlap_start(text, out[-1][0], lo, overlap, sizes)
            while start < lo and count(start, hi) > limit:
                start = min(lo, start + max(1, (lo - start) // 2))
        out.append((start, hi, count(start, hi), "end" if hi == len(text) else kind))
    return out


def _overlap_start(text: str, least: int, lo: int, overlap: int, sizes: _Sizes) -> int:
    """A sentence or word start about ``overlap`` tokens before ``lo``, after the last piece's start."""
    n = int(sizes.upto(lo))
    far = max(least + 1, sizes.char_at(max(0, n - overlap - overlap // 4)))
    goal = max(least + 1, sizes.char_at(max(0, n - overlap)))
    near = max(least + 1, sizes.char_at(max(0, n - overlap + overlap // 4)))
    for pattern in (_SENTENCE, _LINE, _WORD):
        starts = [m.end() for m in pattern.finditer(text, far, near)]
        if starts:
            return min(starts, key=lambda p: abs(p - goal))
    return min(goal, lo)


def split_oversized(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 3000, overlap: int = 100, path: str = tokens.VOCABULARY, with_text: bool = True) -> DataFrame:
    """Pieces of every text of more than ``limit`` tokens, keyed like their document.

    A text of at most ``limit`` bytes cannot have more tokens than that, so such rows are
    left out before they reach Python; this loses nothing.
    """
    import pyarrow as pa

    kept = docs.where(F.octet_length(text) > limit).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {PIECES if with_text else PIECES.rpartition(',')[0]}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(i, k, s, e, n, kind, *([t[s:e]] if with_text else [])) for k, (s, e, n, kind) in enumerate(split_text(t, limit, overlap, path))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return kept.mapInArrow(run, schema)
