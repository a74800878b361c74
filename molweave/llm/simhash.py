"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

The 64 bits are grouped into partitions of correlated bits. A pair within distance t must agree, in some partition
i, within t_i, for any thresholds with sum(t_i + 1) = t + 1 (t_i = -1: the partition is not probed). Every
fingerprint chooses its own thresholds by dynamic programming on the candidates its values are estimated to give,
probes the value table of its partitions with the values inside the chosen balls, and verifies what it meets.

Two levels keep dense groups linear: links at distance 1 (at most 64 for each fingerprint) are contracted first;
then the full distance is probed and only links between different groups leave the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molweave.session import materialise

from .common import LOWER_BYTES, map_text, table
from .components import connected_components

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: fingerprints (at most, about) from which bit groups and candidate counts are estimated
SAMPLE = 20_000
#: shingles hashed at once
CHUNK = 1 << 15
#: partitions of distances up to 5: about 21 bits each, so value lists stay short up to many millions of fingerprints;
#: wider distances take more and shorter partitions and meet more candidates
PARTS = 3
#: values of the largest ball that a fingerprint may probe in one partition
BALL = 64
SPACES = bytes(range(9, 14)) + b" "


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash as an unsigned number; 0 for a text without words."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES)
    words = raw.translate(bytes.maketrans(SPACES, b" " * len(SPACES))).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for begin in range(0, n, CHUNK):
        end = min(begin + CHUNK, n)
        joined = map(b" ".join, zip(*(words[begin + k : end + k] for k in range(size)), strict=True))
        hashes = np.frombuffer(b"".join([digest(x, SEED) for x in joined]), np.uint8)
        ones += np.unpackbits(hashes.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    value = np.packbits(ones * 2 > n)
    return int.from_bytes(value.tobytes(), "big")


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``simhash``, the fingerprint as a signed long. Null and empty texts get 0."""

    def make():
        def run(texts):
            return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]

        return run

    return map_text(df, text, T.StructType([T.StructField("simhash", T.LongType())]), make, keep)


def bit_groups(sample: np.ndarray, parts: int) -> list[list[int]]:
    """64 bit numbers in ``parts`` groups of near equal size, bits that vary together in one group."""
    bits = np.unpackbits(sample.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1].astype(np.float32)
    if len(bits) < 2:
        return [list(range(64))[k::parts] for k in range(parts)]
    centred = bits - bits.mean(0)
    norm = np.sqrt((centred**2).sum(0))
    norm[norm == 0] = 1
    like = np.abs((centred / norm).T @ (centred / norm))
    free, groups = set(range(64)), []
    for k in range(parts):
        want = len(free) // (parts - k)
        # start with the bit that is most bound to the others, then add the bit most bound to the group
        order = sorted(free)
        group = [max(order, key=lambda b: (like[b, order].sum(), -b))]
        free.discard(group[0])
        while len(group) < want:
            order = sorted(free)
            best = order[int(np.argmax(like[np.ix_(order, group)].sum(1)))]
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def values(fps: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of ``group`` as one number for each fingerprint."""
    out = np.zeros(len(fps), np.uint64)
    for k, bit in enumerate(group):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def masks(width: int, radius: int) -> np.ndarray:
    """The exclusive-or masks of a ball, nearest first."""
    out = [0]
    for r in range(1, radius + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(width), r)]
    return np.array(out, np.uint64)


def parts_for(distance: int) -> int:
    """The fewest partitions, ``PARTS`` at least, whose balls of at most ``BALL`` values reach the distance."""
    if not 0 <= distance <= 64:
        raise ValueError(f"a distance between 64-bit fingerprints is 0 to 64, not {distance}")

    def reach(width: int) -> int:
        return max(t + 1 for t in range(width + 1) if sum(comb(width, r) for r in range(t + 1)) <= BALL)

    # more partitions than distance + 1 would leave some without a probe
    fewest = min(PARTS, distance + 1)
    widths = lambda n: [64 // n + (k < 64 % n) for k in range(n)]
    return next(n for n in range(fewest, 65) if sum(map(reach, widths(n))) > distance)


class Plan:
    """Bit groups and the sample's value counts; chooses thresholds for fingerprints."""

    def __init__(self, sample: np.ndarray, scale: float, parts: int, distance: int):
        self.groups, self.distance, self.scale = bit_groups(sample, parts), distance, scale
        self.seen = [np.unique(values(sample, g), return_counts=True) for g in self.groups]

    def estimates(self, fps: np.ndarray) -> np.ndarray:
        """cost[fingerprint, partition, t + 1]: probes plus estimated candidates; 0 for t = -1."""
        top = self.distance
        cost = np.zeros((len(fps), len(self.groups), top + 2))
        for i, group in enumerate(self.groups):
            own, (keys, counts) = values(fps, group), self.seen[i]
            for t in range(top + 1):
                if sum(comb(len(group), r) for r in range(t + 1)) > BALL:
                    cost[:, i, t + 1 :] = np.inf
                    break
                ball = masks(len(group), t)
                near = np.zeros(len(fps))
                for mask in ball if len(keys) else []:
                    at = np.minimum(np.searchsorted(keys, own ^ mask), len(keys) - 1)
                    near += np.where(keys[at] == own ^ mask, counts[at], 0)
                # a value the sample lacks may still occur; count the ball's share of an even spread
                floor = len(ball) * self.scale * max(1, counts.sum()) / 2.0 ** len(group)
                cost[:, i, t + 1] = len(ball) + np.maximum(near * self.scale, floor)
        return cost

    def thresholds(self, fps: np.ndarray) -> np.ndarray:
        """t[fingerprint, partition], by dynamic programming over partitions and the units spent."""
        cost, units = self.estimates(fps), self.distance + 1
        n, parts = len(fps), len(self.groups)
        best = np.full((n, units + 1), np.inf)
        best[:, 0] = 0
        choice = np.zeros((parts, n, units + 1), np.int64)
        for i in range(parts):
            now = np.full((n, units + 1), np.inf)
            for spent in range(units + 1):
                for use in range(spent + 1):
                    total = best[:, spent - use] + cost[:, i, use]
                    better = total < now[:, spent]
                    now[better, spent], choice[i, better, spent] = total[better], use
            best = now
        if not np.isfinite(best[:, units]).all():
            raise ValueError(f"{parts} partitions with balls of {BALL} values do not reach distance {self.distance}")
        out, left = np.zeros((n, parts), np.int64), np.full(n, units)
        for i in reversed(range(parts)):
            out[:, i] = choice[i, np.arange(n), left] - 1
            left -= out[:, i] + 1
        return out


KEYS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("grp", T.LongType())])


def _rows(nodes: DataFrame, plan: Plan, probe: bool) -> DataFrame:
    """Value-table rows of every fingerprint, or its probes."""

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, grp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            unsigned = fp.view(np.uint64)
            t = plan.thresholds(unsigned) if probe else np.zeros((len(fp), len(plan.groups)), np.int64)
            for i, group in enumerate(plan.groups):
                own = values(unsigned, group)
                for radius in range(plan.distance + 1):
                    who = np.flatnonzero(t[:, i] == radius)
                    ball = masks(len(group), radius) if len(who) else ()
                    for k in range(0, len(ball), 64):
                        part = ball[k : k + 64]
                        keys = (own[who][:, None] ^ part[None, :]).ravel().view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), i, np.int32)), pa.array(keys), pa.array(np.repeat(fp[who], len(part))), pa.array(np.repeat(grp[who], len(part)))],
                            names=KEYS.names,
                        )

    dealt = nodes.select("fp", "grp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    return dealt.mapInArrow(run, KEYS)


def _links(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Verified links between fingerprints of different groups, each found from its larger end."""
    table = _rows(nodes, plan, False).select("part", "value", F.col("fp").alias("b"), F.col("grp").alias("grp_b"))
    probes = _rows(nodes, plan, True).withColumnRenamed("fp", "a")
    met = probes.join(
        table,
        (probes.part == table.part)
        & (probes.value == table.value)
        & (F.col("a") > F.col("b"))
        & (F.col("grp") != F.col("grp_b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= plan.distance),
    )
    return met.select("a", "b")


def near_fingerprints(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, component) for distinct fingerprints ``fp``: the smallest fingerprint reachable over links."""
    n = fps.count()
    share = min(1.0, SAMPLE / max(n, 1))
    cut = int(share * (1 << 30))
    sample = fps.where(F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 30)) < cut).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    nodes = fps.select("fp", F.col("fp").alias("grp"))
    for level in dict.fromkeys((min(1, distance), distance)):
        plan = Plan(sample, n / max(len(sample), 1), parts_for(level), level)
        linked = materialise(_links(nodes, plan), "simhash_links")
        groups = nodes.select(F.col("fp").alias("a"), F.col("grp").alias("b")).where("a != b")
        joined = connected_components(linked.unionByName(groups))
        nodes = materialise(nodes.join(joined.withColumnRenamed("id", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp")), "simhash_groups")
    return nodes.withColumnRenamed("grp", "component")


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, simhash, component_id): near-duplicate groups of whole texts.

    ``component_id`` is the smallest key reachable over fingerprints that differ in at most ``distance`` bits.
    Null and empty texts share fingerprint 0 and are linked like any other. Repeated rows stay repeated, null keys
    get the smallest non-null key of their group (null if there is none), an empty table gives an empty result.
    Copies meet as one fingerprint, so a group of copies of any size is one vertex.
    """
    coded = materialise(fingerprints(df.select(F.col(key).alias("id"), F.col(text).alias("text")), keep=["id"]), "simhash")
    classes = materialise(coded.groupBy(F.col("simhash").alias("fp")).agg(F.min("id").alias("first")), "simhash_classes")
    near = near_fingerprints(classes.select("fp"), distance)
    known = near.join(classes, "fp")
    least = known.groupBy("component").agg(F.min("first").alias("component_id"))
    of = known.join(least, "component").select(F.col("fp").alias("simhash"), "component_id")
    return coded.join(of, "simhash").select(F.col("id").alias(key), "simhash", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")
