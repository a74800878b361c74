"""SentencePiece encoding and decoding that keep source offsets (operator 13).

A text is normalised from the left: at every place the longest entry of the model's compiled character map is
replaced (one character stands for itself if none matches), and every normalised character records where it came
from. The normalised text is cut where no piece of the vocabulary could join two characters, so what is cut apart is
encoded on its own: always the pair with the best score, the leftmost of equal ones, as arrays over all distinct units
of a lot. Every piece is projected to its bytes in the source text. Spark partitions the texts; nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_text, table
from .words import per_process

SPACE = "▁"
#: piece types of the file format
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: symbols up to which a unit is merged in arrays; longer ones are merged with a heap
LONG = 32
#: distinct units (about 200 bytes each) that a Python worker keeps before its table starts anew
TABLE_UNITS = 500_000
#: characters that are encoded at once
LOT_CHARS = 2_000_000
NEVER = np.iinfo(np.int32).max


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message: integers, four or eight bytes, or nested bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled character map of a model: a double-array trie over bytes, then the replacements it points to."""

    def __init__(self, data: bytes):
        size = struct.unpack_from("<I", data)[0] if data else 0
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.texts = data[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The replacement of the longest entry that ``text`` has at ``at``, and the entry's length."""
        units, found = self.units, None
        if not units:
            return None
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(units[0])
        for k in range(at, len(text)):
            node ^= text[k]
            if node >= len(units) or units[node] & 0x800000FF != text[k]:
                break
            unit = units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, k + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class PieceModel:
    """Vocabulary, merge ranks and normaliser of a SentencePiece model of type BPE with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            message = list(fields(file.read()))
        trainer = dict(fields(b"".join(v for k, v in message if k == 2)))
        rules = dict(fields(b"".join(v for k, v in message if k == 3)))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only BPE models with byte fallback and spaces before words are supported")
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.plain = not self.map.units and not self.squeeze and self.escape
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.pieces: list[str] = []
        scores, self.types = [], []
        for _, value in (m for m in message if m[0] == 1):
            piece = dict(fields(value))
            self.pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
            self.types.append(piece.get(3, NORMAL))
        if {USER, UNUSED} & set(self.types):
            raise ValueError("user-defined and unused pieces are not supported")
        self._index(scores)

    def _index(self, scores: list[float]) -> None:
        n = self.size = len(self.pieces)
        known = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        for i, p in enumerate(self.pieces):
            if self.types[i] == BYTE:
                self.byte_ids[int(p[3:-1], 16)] = i
        # a symbol is a piece, or a character outside the vocabulary: its code point above all ids
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in known.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        of = lambda part: known.get(part, n + ord(part) if len(part) == 1 else None)
        order = {s: k for k, s in enumerate(sorted(set(scores), reverse=True))}
        rows = []
        for p, i in known.items():
            for k in range(1, len(p)):
                left, right = of(p[:k]), of(p[k:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, order[scores[i]], i))
        rows.sort()
        self.keys = np.array([r[0] for r in rows] + [np.iinfo(np.int64).max], np.int64)
        self.ranks = np.array([r[1] for r in rows] + [NEVER], np.int32)
        self.merged = np.array([r[2] for r in rows] + [-1], np.int32)
        # characters side by side in some piece: nothing joins others
        beside = {ord(a) << 32 | ord(b) for p in known for a, b in zip(p, p[1:], strict=False)}
        self.beside = np.array(sorted(beside), np.int64)
        # a unit may be cut before every space after another character
        self.cuts_at_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in known)
        # characters and source bytes of a piece, a space being one byte
        self.chars = np.array([len(p) for p in self.pieces], np.int32)
        self.widths = np.array([len(p.replace(SPACE, " ").encode()) for p in self.pieces], np.int32)
        surface = [self._surface(i) for i in range(n)]
        self.surface = pa.array(surface, pa.binary())
        self.opens = np.array([t == NORMAL and p.startswith(SPACE) for p, t in zip(self.pieces, self.types, strict=True)])

    def _surface(self, i: int) -> bytes:
        kind = self.types[i]
        if kind == BYTE:
            return bytes([int(self.pieces[i][3:-1], 16)])
        if kind in (CONTROL, UNKNOWN):
            return self.unknown_surface.encode() if kind == UNKNOWN else b""
        return self.pieces[i].replace(SPACE, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and the source byte at which each of its characters begins (and the last one ends)."""
        data = text.encode("utf-8", "replace")
        steps, at = [], 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at : at + size], size
            steps.append((found[0].decode(), at, at + found[1]))
            at += found[1]
        out: list[str] = []
        source: list[int] = []
        first = next((k for k, s in enumerate(steps) if s[0] != " "), len(steps)) if self.squeeze else 0
        if first == len(steps):
            return "", np.zeros(1, np.int64)
        if self.dummy:
            out.append(" ")
            source.append(steps[first][1])
        after_space, end = self.squeeze, 0
        for part, begin, end in steps[first:]:
            if after_space:
                part = part.lstrip(" ")
            out.extend(part)
            source.extend([begin] * len(part))
            if part and self.squeeze:
                after_space = part.endswith(" ")
        if self.squeeze:
            while out and out[-1] in (" ", SPACE):
                out.pop()
                end = source.pop()
        source.append(end)
        joined = "".join(out)
        return joined.replace(" ", SPACE) if self.escape else joined, np.array(source, np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places in the merge table; its last entry is no merge."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, at, len(self.keys) - 1)

    def merge_rows(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, symbols) of finished rows: units of one length, one merge of every row at a time."""
        rows = np.arange(len(symbols))
        ranks = self.ranks[self._find(symbols[:, :-1], symbols[:, 1:])]
        while symbols.shape[1] > 1 and len(rows):
            at = ranks.argmin(1)
            on = ranks[np.arange(len(rows)), at] != NEVER
            yield rows[~on], symbols[~on]
            rows, symbols, ranks, at = rows[on], symbols[on], ranks[on], at[on]
            n, width = symbols.shape
            every = np.arange(n)
            symbols[every, at] = self.merged[self._find(symbols[every, at], symbols[every, at + 1])]
            rest = np.ones((n, width), bool)
            rest[every, at + 1] = False
            symbols = symbols[rest].reshape(n, width - 1)
            # the pair itself goes, and its neighbours change
            rest = np.ones((n, width - 1), bool)
            rest[every, at] = False
            ranks = ranks[rest].reshape(n, width - 2)
            for place in (at - 1, at):
                has = np.flatnonzero((place >= 0) & (place < width - 2))
                p = place[has]
                ranks[has, p] = self.ranks[self._find(symbols[has, p], symbols[has, p + 1])]
        yield rows, symbols

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The same for one long unit: pairs wait in a heap by rank and place."""
        syms = symbols.tolist()
        after, before = list(range(1, len(syms) + 1)), list(range(-1, len(syms) - 1))
        found = self._find(symbols[:-1], symbols[1:])
        heap = [(r, k, syms[k], syms[k + 1], m) for k, (r, m) in enumerate(zip(self.ranks[found].tolist(), self.merged[found].tolist(), strict=True)) if r != NEVER]
        heapq.heapify(heap)
        table = self.pairs

        def push(k: int) -> None:
            hit = table.get((syms[k], syms[after[k]]))
            if hit is not None:
                heapq.heappush(heap, (hit[0], k, syms[k], syms[after[k]], hit[1]))

        while heap:
            _, k, left, right, merged = heapq.heappop(heap)
            nxt = after[k]
            if syms[k] != left or nxt >= len(syms) or syms[nxt] != right:
                continue
            syms[k], syms[nxt] = merged, -1
            after[k] = after[nxt]
            if after[k] < len(syms):
                before[after[k]] = k
                push(k)
            if before[k] >= 0:
                push(before[k])
        return np.array([s for s in syms if s >= 0], np.int32)

    @property
    def pairs(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_pairs"):
            both = zip((self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist(), strict=True)
            self._pairs = dict(zip(both, zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))
        return self._pairs

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of every unit; all ids in a row, and the normalised characters and source bytes of each."""
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        starts = np.cumsum(sizes) - sizes
        # cut on where no piece can join, in one pass over all units
        cut = np.ones(len(points) + 1, bool)
        if len(points) > 1:
            pair = points[:-1] << 32 | points[1:]
            at = np.minimum(np.searchsorted(self.beside, pair), max(len(self.beside) - 1, 0))
            cut[1:-1] = self.beside[at] != pair if len(self.beside) else True
        cut[starts[sizes > 0]] = True
        begins = np.flatnonzero(cut[:-1])
        lengths = np.diff(np.append(begins, len(points)))
        symbols = self.symbol[points]
        where, found = [], []
        for size in np.unique(lengths).tolist():
            which = begins[lengths == size]
            if size == 1:
                where.append(which)
                found.append(symbols[which])
            elif size <= LONG:
                for rows, got in self.merge_rows(symbols[which[:, None] + np.arange(size)]):
                    where.append(np.repeat(which[rows], got.shape[1]))
                    found.append(got.ravel())
            else:
                for begin in which.tolist():
                    got = self.merge_long(symbols[begin : begin + size])
                    where.append(np.full(len(got), begin))
                    found.append(got)
        if not where:
            none = np.zeros(0, np.int32)
            return np.zeros(len(units), np.int64), none, none, none
        place, ids = np.concatenate(where), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        place, ids = place[order], ids[order]
        ids, chars, widths, times = self._fall_back(ids)
        unit = np.repeat(np.searchsorted(starts[sizes > 0], place, "right") - 1, times)
        counts = np.zeros(len(units), np.int64)
        counts[sizes > 0] = np.bincount(unit, minlength=int((sizes > 0).sum()))
        return counts, ids, chars, widths

    def _fall_back(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters without a piece become their bytes; the last byte has the whole character."""
        strange = ids >= self.size
        known = np.where(strange, 0, ids)
        if not strange.any():
            return ids, self.chars[ids], self.widths[ids], np.ones(len(ids), np.int64)
        point = ids - self.size
        times = np.where(strange, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        out = np.repeat(known, times)
        chars, widths = np.repeat(self.chars[known], times), np.repeat(self.widths[known], times)
        last = np.cumsum(times) - 1
        inside = np.repeat(strange, times)
        text = "".join(map(chr, point[strange].tolist())).encode("utf-8", "surrogatepass")
        out[inside] = self.byte_ids[np.frombuffer(text, np.uint8)]
        chars[inside], widths[inside] = 0, 0
        chars[last[strange]], widths[last[strange]] = 1, times[strange]
        return out, chars, widths, times

    def decode(self, lists: list[np.ndarray]) -> list[str]:
        """The text of every id list: invisible marks go, the first space goes, bytes that are no text become U+FFFD."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.zeros(0, np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.size):
            raise IndexError("id outside the vocabulary")
        taken = self.surface.take(pa.array(flat))
        data = taken.buffers()[2].to_pybytes() if len(flat) and taken.buffers()[2] else b""
        ends = np.frombuffer(taken.buffers()[1], np.int32)[: len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        after = np.cumsum(sizes)
        shown = np.flatnonzero(np.diff(ends) > 0)
        first = np.searchsorted(shown, after - sizes)
        out = []
        for k, (a, b) in enumerate(zip((after - sizes).tolist(), after.tolist(), strict=True)):
            begin = int(ends[a])
            for at in shown[first[k] :]:
                if at >= b or not (self.dummy or self.squeeze) or not self.opens[flat[at]]:
                    break
                begin += 1
                # where spaces are squeezed, all at the front go
                if not self.squeeze or ends[at + 1] > begin:
                    break
            out.append(_text(data[begin : int(ends[b])]))
        return out


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as error:
            out += [data[at : at + error.start].decode(), "�" * (error.end - error.start)]
            at += error.end
    return "".join(out)


class UnitTable:
    """Encoded units, kept over the tasks of a Python worker; a full table starts anew."""

    def __init__(self, model: PieceModel, limit: int = TABLE_UNITS):
        self.model, self.limit = model, limit
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if model.cuts_at_space else re.compile("(?s).+")
        self.reset()

    def reset(self) -> None:
        self.known: dict[str, int] = {}
        self.starts = np.zeros(1, np.int64)
        self.ids, self.chars, self.widths = (np.zeros(0, np.int32) for _ in range(3))

    def numbers(self, units: list[str]) -> np.ndarray:
        """The numbers of distinct units."""
        missing = [u for u in units if u not in self.known]
        if len(self.known) + len(missing) > self.limit:
            self.reset()
            missing = units
        if missing:
            counts, *arrays = self.model.encode_units(missing)
            self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
            self.ids, self.chars, self.widths = (np.concatenate(p) for p in zip((self.ids, self.chars, self.widths), arrays, strict=True))
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def units(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct units, the units of all texts in a row by their place among them, and how many each text has.

        In a text with the default rules and no run of spaces, every space begins a unit.
        """
        if self.model.plain and self.model.dummy and self.model.cuts_at_space:
            cut = pc.split_pattern(pa.array(texts, pa.string()), " ")
            coded = cut.flatten().dictionary_encode()
            counts = np.diff(cut.offsets.to_numpy()).astype(np.int64)
            return [SPACE + p for p in coded.dictionary.to_pylist()], coded.indices.to_numpy().astype(np.int64), counts
        return self.units_of([self.model.normalise(t)[0] for t in texts])

    def units_of(self, normalised: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = [self.unit.findall(t) for t in normalised]
        place = {u: k for k, u in enumerate(dict.fromkeys(u for x in found for u in x))}
        flat = np.fromiter((place[u] for x in found for u in x), np.int64, sum(map(len, found)))
        return list(place), flat, np.fromiter(map(len, found), np.int64, len(found))

    def gather(self, found: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of ids of every text; ids, characters and source bytes of all texts in a row."""
        distinct, flat, counts = found
        index = self.numbers(distinct)[flat]
        size = self.starts[index + 1] - self.starts[index]
        after = np.cumsum(size)
        total = int(after[-1]) if len(after) else 0
        at = np.arange(total) - np.repeat(after - size - self.starts[index], size)
        sizes = np.diff(np.append(0, after)[np.append(0, np.cumsum(counts))])
        return sizes, self.ids[at], self.chars[at], self.widths[at]

    def texts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, ends) of every text, with begin and end ids; ``ends`` are bytes of the source text."""
        model = self.model
        fast = model.plain and model.dummy and model.cuts_at_space
        # a text with a run of spaces, a space at an end or a literal space symbol goes the general way
        special = [not fast or "  " in t or t[:1] in ("", " ") or t[-1:] == " " or SPACE in t for t in texts]
        out: list = [None] * len(texts)
        quick = [k for k, s in enumerate(special) if not s]
        if quick:
            sizes, ids, _, widths = self.gather(self.units([texts[k] for k in quick]))
            self._place(out, quick, sizes, ids, widths)
        rest = [k for k, s in enumerate(special) if s]
        if rest:
            normal = [model.normalise(texts[k]) for k in rest]
            sizes, ids, chars, _ = self.gather(self.units_of([n for n, _ in normal]))
            after = np.cumsum(sizes)
            for k, (_, source), a, b in zip(rest, normal, (after - sizes).tolist(), after.tolist(), strict=True):
                # the last byte of the text is where all pieces end
                out[k] = self._marked(ids[a:b], source[np.cumsum(chars[a:b])], int(source[-1]))
        return out

    def _place(self, out: list, which: list[int], sizes: np.ndarray, ids: np.ndarray, widths: np.ndarray) -> None:
        after = np.cumsum(sizes)
        total = np.append(0, np.cumsum(widths))
        for k, a, b in zip(which, (after - sizes).tolist(), after.tolist(), strict=True):
            # the space before the text is not in it
            ends = total[a + 1 : b + 1] - total[a] - 1
            out[k] = self._marked(ids[a:b], ends, int(ends[-1]))

    def _marked(self, ids: np.ndarray, ends: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[self.model.begin], ids, [self.model.end]]).astype(np.int32), np.concatenate([[0], ends, [last]])


OUTPUT = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("ends", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.StringType()),
    ]
)


def piece_roundtrip(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None, lot_chars: int = LOT_CHARS) -> DataFrame:
    """Add ``ids`` and ``ends`` (binary, little-endian unsigned 32-bit), ``n_tokens`` and ``decoded``.

    ``ends`` holds the byte of the source text where the span of each id ends; a span begins where the one before
    ends, so the dummy space, begin and end ids and all but the last byte of a character without a piece have empty
    spans. ``path`` is a model of type BPE with byte fallback (default: the public 32k one). Null and empty texts have
    the begin and end ids only and decode to the empty text. Texts of any length are encoded whole, repeated rows give
    repeated results, an empty table an empty one; input columns named like an output are replaced.
    """

    def make():
        import public_tokenizers

        file = path or public_tokenizers.path("piece_bpe_32k.model")
        known = per_process(("pieces", file, TABLE_UNITS), lambda: UnitTable(PieceModel(file)))

        def run(texts: list[str | None]) -> list[pa.Array]:
            coded = known.texts([t or "" for t in texts])
            return [
                pa.array([x.astype("<u4").tobytes() for x, _ in coded], pa.binary()),
                pa.array([e.astype("<u4").tobytes() for _, e in coded], pa.binary()),
                pa.array([len(x) for x, _ in coded], pa.int64()),
                pa.array(known.model.decode([x for x, _ in coded]), pa.string()),
            ]

        return run

    return map_text(df, text, OUTPUT, make, keep, lot_chars)


def positions(packed: Column | str) -> Column:
    """``ids`` or ``ends`` as an array of long."""
    words = F.regexp_extract_all(F.hex(packed), F.lit("[0-9A-F]{8}"), F.lit(0))
    turned = lambda w: F.concat(*(F.substring(w, k, 2) for k in (7, 5, 3, 1)))
    return F.transform(words, lambda w: F.conv(turned(w), 16, 10).cast("long"))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and decoded texts; ``spans_sha256`` is the digest of the span ends."""
    coded = piece_roundtrip(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2("ends", 256).alias("spans_sha256"),
    )
