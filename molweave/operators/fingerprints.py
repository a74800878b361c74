"""Bit fingerprints: long form ``(id, bit)``, packed form ``words array<bigint>``."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from molweave.constants import CHEM_RADIUS, CHEM_WIDTH
from molweave.functions.text import short_id

WORD = 64
MAX_COLUMNS = 64
#: bits that a task holds unpacked at a time
STEP_BITS = 1 << 24


def words_for(width: int) -> int:
    return -(-width // WORD)


def pack_bits(df: DataFrame, by: Sequence[str], width: int, bit: str = "bit") -> DataFrame:
    """Long form to packed form. Repeated bits collapse before the shuffle; a null bit sets nothing."""
    mask = F.expr(f"shiftleft(1L, cast(`{bit}` % {WORD} as int))")
    word = F.floor(F.col(bit) / WORD)
    if words_for(width) > MAX_COLUMNS:
        return _pack_wide(df, by, width, word, mask)
    parts = [
        F.coalesce(F.bit_or(F.when(word == i, mask)), F.lit(0).cast("long")).alias(f"_w{i}")
        for i in range(words_for(width))
    ]
    packed = df.groupBy(*by).agg(*parts)
    return packed.select(*by, F.array(*(f"_w{i}" for i in range(words_for(width)))).alias("words"))


def _pack_wide(df: DataFrame, by: Sequence[str], width: int, word: Column, mask: Column) -> DataFrame:
    """Packing by word number first, where one column per word would be too many."""
    parts = df.groupBy(*by, word.alias("_word")).agg(F.bit_or(mask).alias("_value"))
    entry = F.when(F.col("_word").isNotNull(), F.struct("_word", "_value"))
    grouped = parts.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_words"))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(words_for(width) - 1).cast("bigint"))
    value = lambda i: F.coalesce(F.try_element_at("_words", i), F.lit(0).cast("bigint"))
    return grouped.select(*by, F.transform(places, value).alias("words"))


def pack_lists(df: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Lists ``bits`` of one row per key to packed form. Needs no shuffle; what is null or outside sets nothing."""
    source = df.select(*by, F.col("bits").cast("array<bigint>").alias("bits"))
    schema = StructType([*(source.schema[c] for c in by), StructField("words", ArrayType(LongType()))])
    n_words = words_for(width)
    step = max(1, STEP_BITS // (n_words * WORD))

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                lists = batch.column(len(by))
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                bit = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
                good = (bit >= 0) & (bit < n_words * WORD)
                on = np.zeros((batch.num_rows, n_words * WORD), dtype=bool)
                on[row[good], bit[good]] = True
                packed = np.packbits(on, axis=1, bitorder="little").view(np.int64)
                words = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel()), n_words).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(by))), words], names=schema.names)

    return source.mapInArrow(run, schema)


def bit_text(df: DataFrame, keep: Sequence[str], width: int) -> DataFrame:
    """Set bits of packed vectors as text, in order: ``keep columns, bits``. Needs no shuffle."""
    source = df.select(*keep, "words")
    schema = StructType([*(source.schema[c] for c in keep), StructField("bits", StringType())])

    def run(batches):
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                words = batch.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                on = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")[:, :width]
                row, bit = np.nonzero(on)
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                text = pc.binary_join(pa.ListArray.from_arrays(ends, pa.array(bit).cast(pa.string())), ",")
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), text], names=schema.names)

    step = max(1, STEP_BITS // max(1, words_for(width) * WORD))
    return source.mapInArrow(run, schema)


def unpack_bits(df: DataFrame, width: int, keep: Sequence[str]) -> DataFrame:
    """Packed form to long form; rows without a bit give none. Needs no shuffle."""
    is_on = "(shiftright(element_at(words, cast(b div 64 as int) + 1), cast(b % 64 as int)) & 1L) = 1L"
    on = F.expr(f"filter(sequence(0, {width - 1}), b -> {is_on})")
    return df.select(*keep, F.explode(on).alias("bit"))


def bit_count(words: Column) -> Column:
    zero = F.lit(0)
    return F.aggregate(words, zero, lambda acc, w: acc + F.bit_count(w))


# --- concatenation of two fingerprints of one compound


def _concatenated(pairs: DataFrame, left_width: int, right_width: int) -> DataFrame:
    """``pairs`` holds ``name, ord, words, words2``; the second vector is shifted by the first width."""
    if left_width % WORD == 0:
        return pairs.select("name", "ord", F.concat("words", "words2").alias("words"))
    first = unpack_bits(pairs, left_width, ["name", "ord"])
    second = unpack_bits(
        pairs.select("name", "ord", F.col("words2").alias("words")), right_width, ["name", "ord"]
    )
    shifted = second.withColumn("bit", F.col("bit") + left_width)
    none = pairs.select("name", "ord", F.lit(None).cast("int").alias("bit"))
    return pack_bits(
        first.unionByName(shifted).unionByName(none), ["name", "ord"], left_width + right_width
    )


def concat_by_id(
    chem: DataFrame, box: DataFrame, chem_width: int, box_width: int, key: str = "ext_id"
) -> DataFrame:
    """Concatenate fingerprints that share an exact compound id: one equi-join."""
    right = box.select(key, F.col("words").alias("words2"))
    return _concatenated(chem.join(right, key), chem_width, box_width)


def concat_by_containment(
    chem: DataFrame, box: DataFrame, chem_width: int, box_width: int
) -> DataFrame:
    """Concatenate with the first box vector whose name contains the compound's short id.

    Containment is turned into an equi-join: box names are cut into their substrings of the lengths
    that short ids have, and each substring keeps only its first box vector. A short id that occurs in
    every name therefore still meets one row.
    """
    wanted = chem.withColumn("_short", short_id(F.col("name")))
    sizes = [r[0] for r in wanted.select(F.length("_short")).distinct().collect()]
    none = F.array().cast("array<string>")

    def pieces(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("name") - size + 1)
        cut = F.transform(starts, lambda start: F.substring(F.col("name"), start, F.lit(size)))
        return F.when(F.length("name") >= size, cut).otherwise(none)

    every = F.concat(none, *(pieces(size) for size in sizes))
    # only the pieces that are asked for, and their first box compound, go on; vectors follow at the end
    pieces_of = box.select(F.explode(F.array_distinct(every)).alias("_short"), F.col("ord").alias("_box"))
    asked = pieces_of.join(wanted.select("_short").distinct(), "_short", "left_semi")
    first = asked.groupBy("_short").agg(F.min("_box").alias("_box"))
    chosen = box.select(F.col("ord").alias("_box"), F.col("words").alias("words2"))
    pairs = wanted.join(first, "_short").join(chosen, "_box").select("name", "ord", "words", "words2")
    return _concatenated(pairs, chem_width, box_width)


# --- circular fingerprints

_PRIME = 2147483647


def _mix(left: Column, right: Column) -> Column:
    """Whole-number hash of two values below 2**31; plain arithmetic, so any SQL engine can repeat it."""
    t = (left * 1000003 + right) % _PRIME
    return ((t * t) % _PRIME * 48271 + t * 16807 + 1) % _PRIME


def element_code(element: Column) -> Column:
    """Number of an element symbol from its first two characters."""
    second = F.substring(element, 2, 1)
    return F.ascii(F.substring(element, 1, 1)).cast("long") * 256 + F.when(
        second == "", 0
    ).otherwise(F.ascii(second))


# fixed values: codes of bond types
BOND_CODES = {"1": 1, "2": 2, "3": 3, "ar": 4, "am": 5}


def bond_code(btype: Column) -> Column:
    code = None
    for kind, value in BOND_CODES.items():
        code = F.when(btype == kind, value) if code is None else code.when(btype == kind, value)
    return code.otherwise(6).cast("long")


def _adjacency(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """Atoms with their bonds: ``mol_id, serial, element, near`` (``to, code, bond``)."""
    low, high = F.least("a", "b").cast("bigint"), F.greatest("a", "b").cast("bigint")
    ends = F.array(
        F.struct(F.col("a").alias("serial"), F.col("b").alias("to")),
        F.struct(F.col("b").alias("serial"), F.col("a").alias("to")),
    )
    edges = (
        bonds.where("a <> b")
        .select("mol_id", bond_code(F.col("btype")).alias("code"), _mix(low, high).alias("bond"), F.inline(ends))
        .select(
            "mol_id",
            F.col("serial").cast("int").alias("serial"),
            F.lit(None).cast("string").alias("element"),
            F.struct(F.col("to").cast("int").alias("to"), "code", "bond").alias("near"),
        )
    )
    alone = F.lit(None).cast("struct<to: int, code: bigint, bond: bigint>").alias("near")
    rows = atoms.select("mol_id", F.col("serial").cast("int").alias("serial"), "element", alone)
    grouped = rows.unionByName(edges).groupBy("mol_id", "serial")
    found = grouped.agg(F.max("element").alias("element"), F.collect_list("near").alias("near"))
    return found.where("element is not null")


def _sent(state: DataFrame) -> DataFrame:
    """Every atom's row once per bond, addressed to the other end, and once to itself (no ``code``)."""
    none = F.lit(None).cast("bigint")
    itself = F.struct(F.col("serial").alias("to"), none.alias("code"), none.alias("bond"))
    return state.select("*", F.explode(F.array_append("near", itself)).alias("m"))


def _received(state: DataFrame, *parts: Column) -> DataFrame:
    """What arrives at every atom: its own row (if there is such an atom) and sums over its bonds."""
    # a list of one, as lists aggregate by hashing where a plain "first" of arrays would sort
    own = F.when(F.col("m.code").isNull(), F.struct(*(c for c in state.columns if c not in ("mol_id", "serial"))))
    found = _sent(state).groupBy("mol_id", F.col("m.to").alias("serial")).agg(
        F.collect_list(own).alias("own"), *parts
    )
    named = [c for c in found.columns if c != "own"]
    return found.where(F.size("own") > 0).select(*named, F.col("own")[0].alias("own")).select(*named, "own.*")


def circular_environments(atoms: DataFrame, bonds: DataFrame, radius: int = CHEM_RADIUS) -> DataFrame:
    """Hashed atom environments ``mol_id, round, hash`` up to ``radius`` bonds.

    An atom starts from its element, its degree and its hydrogen count. In each round the atoms send
    their hash along their bonds and mix in what they receive; the received values are summed, so their
    order does not matter. One aggregation per round does it, keyed by atom, so that a large molecule is
    spread like many small ones. An environment that covers the same bonds as one already listed (an
    earlier round, or a smaller hash of the same round) is the same piece of the molecule and is dropped.
    """
    near_message = F.col("m.code").isNotNull()
    counted = _received(
        _adjacency(atoms, bonds),
        F.count_if(near_message).alias("degree"),
        F.count_if(near_message & (F.col("element") == "H")).alias("hydrogens"),
    )
    start = _mix(_mix(element_code(F.col("element")), F.col("degree")), F.col("hydrogens"))
    none = F.array().cast("array<bigint>")
    # an atom by itself covers no bond; a negative number of its own keeps it listed
    itself = F.array((-1 - F.col("serial")).cast("bigint"))
    entry = lambda number, cover: F.struct(
        F.lit(number).alias("round"), "hash", cover.alias("cover")
    )
    state = (
        counted.select("mol_id", "serial", "near", start.alias("hash"), none.alias("cover"))
        .withColumn("listed", F.array(entry(0, itself)))
    )
    for number in range(1, radius + 1):
        received = _received(
            state,
            (F.sum(F.when(near_message, _mix(F.col("m.code"), F.col("hash")))) % _PRIME).alias("total"),
            # an atom has few bonds, so these lists are short
            F.collect_list(F.when(near_message, F.array_append("cover", F.col("m.bond")))).alias("reach"),
        )
        state = (
            received.withColumn("cover", F.sort_array(F.array_union("cover", F.flatten("reach"))))
            .withColumn(
                "hash",
                F.when(F.col("total").isNull(), F.col("hash")).otherwise(
                    _mix(F.col("hash") + number, F.col("total"))
                ),
            )
            .withColumn(
                "listed",
                F.when(F.col("total").isNull(), F.col("listed")).otherwise(
                    F.array_append("listed", entry(number, F.col("cover")))
                ),
            )
            .select("mol_id", "serial", "near", "hash", "cover", "listed")
        )
    # round and hash as one number, so that the smallest is found by hash aggregation
    number = F.col("round").cast("bigint") * (_PRIME + 1) + F.col("hash")
    found = state.select("mol_id", F.inline("listed")).select("mol_id", "cover", number.alias("number"))
    first = found.groupBy("mol_id", "cover").agg(F.min("number").alias("number"))
    return first.select(
        "mol_id",
        F.shiftright("number", 31).cast("int").alias("round"),
        F.col("number").bitwiseAND(F.lit(_PRIME).cast("bigint")).alias("hash"),
    )


# --- the same inside records, a batch of them as flat arrays


def _mix_numbers(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """:func:`_mix` of arrays."""
    t = (left * 1000003 + right) % _PRIME
    return ((t * t) % _PRIME * 48271 + t * 16807 + 1) % _PRIME


def _flat(column: pa.Array, *names: str) -> tuple[np.ndarray, list[pa.Array]]:
    """Row numbers and fields of a list column's entries that have no null among the fields."""
    row = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
    entries = column.flatten()
    fields = [pc.struct_field(entries, n) for n in names]
    good = np.ones(len(row), dtype=bool)
    for f in fields:
        good &= f.is_valid().to_numpy(zero_copy_only=False)
    return row[good], [f.filter(pa.array(good)) for f in fields]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys``, the first one foremost, and where a new group begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, new


def _atoms_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(molecule, serial, element code, is hydrogen) of atoms, ordered; of one serial the larger element counts."""
    mol, (serial, element) = _flat(column, "serial", "element")
    coded = element.dictionary_encode()
    names = coded.dictionary.to_pylist()
    rank = np.empty(len(names), dtype=np.int64)
    rank[sorted(range(len(names)), key=names.__getitem__)] = np.arange(len(names))
    kind = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.array([ord(n[0]) * 256 + (ord(n[1]) if len(n) > 1 else 0) if n else 0 for n in names], dtype=np.int64)
    serial = serial.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((-rank[kind] if len(names) else kind, serial, mol))
    mol, serial, kind = mol[order], serial[order], kind[order]
    first = np.ones(len(mol), dtype=bool)
    first[1:] = (mol[1:] != mol[:-1]) | (serial[1:] != serial[:-1])
    kind = kind[first]
    hydrogen = np.array([n == "H" for n in names], dtype=bool)
    return mol[first], serial[first], codes[kind], hydrogen[kind] if len(names) else np.zeros(0, dtype=bool)


def batch_environments(atoms: pa.Array, bonds: pa.Array, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(molecule, hash) of the environments of a batch: :func:`circular_environments` over list columns
    ``serial, element`` and ``a, b, code``. The bonds that an environment covers are a bit set."""
    mol, serial, code, hydrogen = _atoms_of(atoms)
    owner, ends = _flat(bonds, "a", "b", "code")
    a, b, kind = (e.to_numpy(zero_copy_only=False).astype(np.int64) for e in ends)
    # atoms by molecule and serial, in one number
    low = int(min(serial.min(initial=0), a.min(initial=0), b.min(initial=0)))
    span = int(max(serial.max(initial=0), a.max(initial=0), b.max(initial=0))) - low + 1
    known = mol * span + serial - low
    at_a, at_b = (np.searchsorted(known, owner * span + e - low) for e in (a, b))
    found = [(i < len(known)) & (known[np.minimum(i, len(known) - 1)] == owner * span + e - low) if len(known) else i < 0 for i, e in ((at_a, a), (at_b, b))]
    good = (a != b) & found[0] & found[1]
    owner, a, b, kind, at_a, at_b = (x[good] for x in (owner, a, b, kind, at_a, at_b))
    # bonds of a molecule numbered by their own hash; equal ones are one
    bond = _mix_numbers(np.minimum(a, b), np.maximum(a, b))
    order, new = _groups(owner, bond)
    group = np.cumsum(new) - 1
    number = np.empty(len(owner), dtype=np.int64)
    begins = np.flatnonzero(new)
    head = owner[order][begins] if len(begins) else np.zeros(0, np.int64)
    inside = np.arange(len(begins)) - np.searchsorted(head, head)
    number[order] = inside[group] if len(begins) else 0
    words = int(number.max(initial=0)) // WORD + 1
    # every bond in both directions, by receiver
    to, of = np.concatenate([at_a, at_b]), np.concatenate([at_b, at_a])
    kind, number = np.concatenate([kind, kind]), np.concatenate([number, number])
    turn = np.argsort(to, kind="stable")
    to, of, kind, number = to[turn], of[turn], kind[turn], number[turn]
    receivers, begin = np.unique(to, return_index=True)
    own = np.zeros((len(to), words), dtype=np.uint64)
    own[np.arange(len(to)), number // WORD] = np.left_shift(np.uint64(1), (number % WORD).astype(np.uint64))
    degree = np.bincount(to, minlength=len(mol))
    hydrogens = np.bincount(to, weights=hydrogen[of], minlength=len(mol)).astype(np.int64)
    value = _mix_numbers(_mix_numbers(code, degree), hydrogens)
    cover = np.zeros((len(mol), words), dtype=np.uint64)
    listed = [(mol, value)]
    grown = []
    for step in range(1, radius + 1):
        if not len(to):
            break
        total = np.add.reduceat(_mix_numbers(kind, value[of]), begin) % _PRIME
        reach = np.bitwise_or.reduceat(cover[of] | own, begin, axis=0)
        value, cover = value.copy(), cover.copy()
        cover[receivers] |= reach
        value[receivers] = _mix_numbers(value[receivers] + step, total)
        grown.append((mol[receivers], cover[receivers], np.full(len(receivers), step), value[receivers]))
    if grown:
        owners, covers, steps, values = (np.concatenate([g[k] for g in grown]) for k in range(4))
        order = np.lexsort((values, steps, *covers.T, owners))
        o, c = owners[order], covers[order]
        first = np.ones(len(o), dtype=bool)
        first[1:] = (o[1:] != o[:-1]) | (c[1:] != c[:-1]).any(axis=1)
        listed.append((o[first], values[order][first]))
    return np.concatenate([x[0] for x in listed]), np.concatenate([x[1] for x in listed])


#: molecules that are worked on at once, and bonds from which a molecule is worked on alone (its bit sets are wide)
LOT_MOLECULES, WIDE_BONDS = 4096, 512


def record_fingerprints(
    records: DataFrame, keep: Sequence[str], radius: int = CHEM_RADIUS, width: int = CHEM_WIDTH
) -> DataFrame:
    """Packed circular fingerprints of molecules that are one row each, without a shuffle.

    ``records`` holds ``atoms array<struct<serial, element>>`` and ``bonds array<struct<a, b, btype>>``;
    ``keep`` names the columns that stay. Gives what :func:`circular_fingerprints` gives for long tables.
    """
    code = lambda b: F.struct(b["a"].cast("int").alias("a"), b["b"].cast("int").alias("b"), bond_code(b["btype"]).alias("code"))
    atom = lambda a: F.struct(a["serial"].cast("int").alias("serial"), a["element"].alias("element"))
    source = records.select(*keep, F.transform("atoms", atom).alias("_atoms"), F.transform("bonds", code).alias("_bonds"))
    schema = StructType([*(source.schema[c] for c in keep), StructField("words", ArrayType(LongType()))])
    n_words = words_for(width)

    def run(batches):
        for batch in batches:
            bonds = pc.fill_null(pc.list_value_length(batch.column(len(keep) + 1)), 0).to_numpy(zero_copy_only=False)
            for begin, end in _lots(bonds):
                part = batch.slice(begin, end - begin)
                mol, hashes = batch_environments(part.column(len(keep)), part.column(len(keep) + 1), radius)
                bit = hashes % width
                packed = np.zeros((part.num_rows, n_words), dtype=np.uint64)
                np.bitwise_or.at(packed, (mol, bit // WORD), np.left_shift(np.uint64(1), (bit % WORD).astype(np.uint64)))
                words = pa.FixedSizeListArray.from_arrays(pa.array(packed.ravel().view(np.int64)), n_words).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), words], names=schema.names)

    return source.mapInArrow(run, schema)


def _lots(bonds: np.ndarray):
    """Ranges of rows: many small molecules, or one with many bonds."""
    begin = 0
    for at in np.flatnonzero(bonds > WIDE_BONDS).tolist() + [len(bonds)]:
        for k in range(begin, at, LOT_MOLECULES):
            yield k, min(k + LOT_MOLECULES, at)
        if at < len(bonds):
            yield at, at + 1
        begin = at + 1


def circular_bits(
    atoms: DataFrame, bonds: DataFrame, radius: int = CHEM_RADIUS, width: int = CHEM_WIDTH
) -> DataFrame:
    """Long-form circular fingerprint ``mol_id, bit``."""
    found = circular_environments(atoms, bonds, radius)
    return found.select("mol_id", F.pmod("hash", F.lit(width)).cast("int").alias("bit")).distinct()


def circular_fingerprints(
    atoms: DataFrame, bonds: DataFrame, radius: int = CHEM_RADIUS, width: int = CHEM_WIDTH
) -> DataFrame:
    found = circular_environments(atoms, bonds, radius)
    bits = found.select("mol_id", F.pmod("hash", F.lit(width)).cast("int").alias("bit"))
    return pack_bits(bits, ["mol_id"], width)
