"""Texts put together from a bounded table of encoded pieces, shared by the token operators.

A single space between two visible characters is always a word boundary of the byte-level pattern, and the space
belongs to the word after it. So a text is cut at its spaces and every distinct piece of a task is encoded once;
texts are then put together from the table by array operations. A text in which a space has another white space
beside it (or an end of the text) is encoded as a whole. Memory follows the batch and the bounded table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: distinct pieces a table keeps before it makes room
TABLE_PIECES = 600_000
#: marks that often end a piece
MARKS = ",.;:!?"


class PieceTable:
    """Ids of pieces.

    ``encode`` gets a list of strings, and how many of its first ones are pieces after a space; it returns how many ids
    each string has, and all ids in a row. A full table starts anew, or with ``keep`` from the pieces met again.
    """

    def __init__(self, encode: Callable[[list[str], int], tuple[np.ndarray, np.ndarray]], limit: int = TABLE_PIECES, keep: bool = False):
        self.encode, self.limit, self.keep = encode, limit, keep
        self.reset()

    def reset(self) -> None:
        self.after_space: dict[str, int] = {}
        self.alone: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.met = np.zeros(0, bool)

    def shrink(self) -> None:
        """Keep the pieces met again since the last time, if they are not too many."""
        kept = np.flatnonzero(self.met)
        if len(kept) > self.limit // 2:
            self.reset()
            return
        place = np.full(len(self.met), -1)
        place[kept] = np.arange(len(kept))
        size, begin = np.diff(self.starts)[kept], self.starts[kept]
        after = np.cumsum(size)
        self.ids = self.ids[np.arange(int(after[-1]) if len(after) else 0) - np.repeat(after - size - begin, size)]
        self.starts = np.concatenate([[0], after]).astype(np.int64)
        places = place.tolist()
        for name in ("after_space", "alone"):
            known = getattr(self, name)
            setattr(self, name, {p: places[k] for p, k in known.items() if k >= 0 and places[k] >= 0})
        self.met = np.zeros(len(kept), bool)

    def add(self, spaced: list[str], alone: list[str]) -> None:
        """Make new pieces known; a piece at which a text may not be cut gets the number -1.

        One mark after a letter or digit is a word of its own, so "word," is put together from "word" and ",".
        """
        good = [p for p in spaced if p and not p[0].isspace() and not p[-1].isspace()]
        self.after_space.update(dict.fromkeys(spaced, -1))
        marked = [p for p in good if p[-1] in MARKS and p[-2:-1].isalnum()]
        rest = set(good).difference(marked)
        stems = {p[:-1] for p in marked}
        plain = list(rest | stems.difference(self.after_space))
        if not plain and not alone and not marked:
            return
        known = {p: self.after_space[p] for p in stems if p not in rest and p in self.after_space}
        marks = list(MARKS)
        sizes, flat = self.encode([" " + p for p in plain] + alone + marks, len(plain))
        base, n = len(self.starts) - 1, len(plain) + len(alone)
        at = dict(zip(plain, range(base, base + len(plain)), strict=True)) | known
        self.after_space.update((p, at[p]) for p in rest)
        self.alone.update(zip(alone, range(base + len(plain), base + n), strict=True))
        after = np.cumsum(sizes)
        self.starts = np.concatenate([self.starts, self.starts[-1] + after[:n]])
        self.ids = np.concatenate([self.ids, flat[: int(after[n - 1]) if n else 0]])
        # stems with their mark
        stem = np.fromiter((at[p[:-1]] for p in marked), np.int64, len(marked))
        which = np.fromiter(map(MARKS.index, (p[-1] for p in marked)), np.int64, len(marked))
        width, begin = self.starts[stem + 1] - self.starts[stem], self.starts[stem]
        tail, tail_at = sizes[n:][which], (after - sizes)[n:][which]
        size = width + tail
        end = np.cumsum(size)
        new = np.arange(int(end[-1]) if len(end) else 0)
        inside = new - np.repeat(end - size, size)
        head = inside < np.repeat(width, size)
        ids = np.empty(len(new), np.int32)
        ids[head] = self.ids[(np.repeat(begin, size) + inside)[head]]
        ids[~head] = flat[(np.repeat(tail_at - width, size) + inside)[~head]]
        base = len(self.starts) - 1
        self.after_space.update(zip(marked, range(base, base + len(marked)), strict=True))
        self.starts = np.concatenate([self.starts, self.starts[-1] + end])
        self.ids = np.concatenate([self.ids, ids])

    def numbers(self, spaced: list[str], alone: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of distinct pieces after a space and of pieces at the front of a text."""
        look = lambda known, pieces: np.fromiter(map(known.get, pieces, repeat(-2)), np.int64, len(pieces))
        index, front = look(self.after_space, spaced), look(self.alone, alone)
        if self.keep:
            for found in (index, front):
                self.met[found[found >= 0]] = True
        for make_room in (self.shrink, self.reset, None) if self.keep else (self.reset, None):
            at = np.flatnonzero(index == -2)
            new, raw = [spaced[i] for i in at.tolist()], list({p for p, k in zip(alone, front.tolist(), strict=True) if k == -2})
            if make_room is None or len(self.after_space) + len(self.alone) + len(new) + len(raw) <= self.limit:
                break
            make_room()
            index, front = look(self.after_space, spaced), look(self.alone, alone)
        if new or raw:
            self.add(new, raw)
            index[at], front = look(self.after_space, new), look(self.alone, alone)
        if self.keep:
            self.met = np.concatenate([self.met, np.zeros(len(self.starts) - 1 - len(self.met), bool)])
        return index, front

    def texts(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        offsets, pieces = offsets - offsets[0], cut.flatten()
        coded = pieces.dictionary_encode()
        firsts = [p if p == p.strip() else "" for p in pieces.take(pa.array(offsets[:-1])).to_pylist()]
        numbers, front = self.numbers(coded.dictionary.to_pylist(), firsts)
        index = numbers[coded.indices.to_numpy()]
        index[offsets[:-1]] = front
        bad = np.fromiter((not f for f in firsts), bool, len(firsts)) | (np.minimum.reduceat(index, offsets[:-1]) < 0)
        index[index < 0] = 0
        begin, size = self.starts[index], self.starts[index + 1] - self.starts[index]
        after = np.cumsum(size)
        # places in 32 bits, as a lot and the table are far smaller
        flat = self.ids[np.arange(int(after[-1]), dtype=np.int32) - np.repeat((after - size - begin).astype(np.int32), size)]
        ends = after[offsets[1:] - 1].tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        whole = np.flatnonzero(bad)
        if len(whole):
            sizes, flat = self.encode([texts[i].as_py() for i in whole.tolist()], 0)
            for i, ids in zip(whole.tolist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = ids
        return out


def rows_of(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and all values in a row of a list of lists."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return sizes, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))


def per_process(key: tuple, make: Callable[[], object]) -> object:
    """``make()``, kept by the Python worker for its later tasks. Only for values that depend on ``key`` alone."""
    import sys
    from types import ModuleType

    kept = sys.modules.setdefault("_molweave_worker", ModuleType("_molweave_worker")).__dict__
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def slices(sizes: list[int], limit: int) -> list[slice]:
    """Slices of rows of about ``limit`` characters together; a longer text is a slice of its own."""
    out, begin, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            out.append(slice(begin, i))
            begin, total = i, 0
        total += size
    if sizes:
        out.append(slice(begin, len(sizes)))
    return out
