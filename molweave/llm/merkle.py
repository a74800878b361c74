"""Merkle manifest of a dataset, proved by a recursive query (operator 12).

Every row is a leaf; per source, every three consecutive nodes become their parent until one is left, and the subroots
are joined to one root in the same way. Built levels are stored as node rows that hold the way to the node seven levels
up: for each level the siblings to the left and to the right, and a link to the ancestor. A recursive query starts at
the (possibly tampered) leaves, follows the links to the root, appends the siblings and folds the hashes.

Ranks come from range-partitioned keys, never from one group per source; a group of the build holds
2,187 nodes at most. The leaves of a group share every link above it, so they climb as one row: their folded digests side
by side, and the siblings above the group once. Digests travel as bytes, a leaf's own siblings are made again from its group when the
proof is hashed, and node rows are sent to the tasks, so that a link costs 32 bytes per leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.session import materialise

from .common import table
from .sharding import ranked

#: children of a node, levels that one link climbs
ARITY, CLIMB = 3, 7
BLOCK = ARITY**CLIMB
#: tree number of the tree over subroots, and of what is above the root
TOP, ABOVE = -1, -2
#: node rows that are sent to the tasks
SENT_NODES = 50_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def coded(column: Column) -> Column:
    """A value with its length in front, ``-`` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _levels(n: Column) -> Column:
    """Levels that a block climbs in a tree with ``n`` nodes: up to the last one, or a whole link."""
    out = F.lit(CLIMB)
    for k in reversed(range(CLIMB)):
        out = F.when(n <= ARITY**k, k).otherwise(out)
    return out


def _at(level: Column, place: Column) -> Column:
    """A digest of the level, empty beyond its end."""
    return F.coalesce(F.get(level, place), F.lit(""))


def _parents(level: Column) -> Column:
    """The digests of the runs of ``level``."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(level) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda r: F.sha2(F.concat(*(_at(level, r * ARITY + k) for k in range(ARITY))), 256))


def _sides(level: Column, at: Column) -> Column:
    """Digests left and right of place ``at`` (0-based) in its run, as bytes."""
    inside = F.pmod(at, F.lit(ARITY))
    run = at - inside
    left = F.concat(*(F.when(inside > k, F.get(level, run + k)).otherwise("") for k in range(ARITY - 1)))
    right = F.concat(*(F.when(inside < k, _at(level, run + k)).otherwise("") for k in range(1, ARITY)))
    return F.struct(F.unhex(left).alias("left"), F.unhex(right).alias("right"))


def _grouped(nodes: DataFrame) -> DataFrame:
    """Blocks of ``nodes`` (tree, idx, n, hash and what a node carries): ``tree, block, n`` and the nodes in order as ``rows``."""
    carried = [c for c in nodes.columns if c not in ("tree", "idx", "n", "hash")]
    rows = F.array_sort(F.collect_list(F.struct("idx", "hash", *carried)))
    # one row per block of 2,187 nodes at most
    return nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).cast("long").alias("block")).agg(F.max("n").alias("n"), rows.alias("rows"))


def _raised(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the digests of their levels as text, the number ``high`` of levels to the block's top, and its digest ``top``."""
    out = blocks.withColumn("high", _levels(F.col("n"))).withColumn("level0", F.transform("rows", lambda r: F.lower(F.hex(r["hash"]))))
    for k in range(CLIMB):
        level = F.col(f"level{k}")
        out = out.withColumn(f"level{k + 1}", F.when(F.col("high") > k, _parents(level)).otherwise(level))
    return out.withColumn("top", F.unhex(F.col(f"level{CLIMB}")[0]))


def _steps(place: Column) -> Column:
    """The siblings of the node at ``place`` of a raised block, level by level up to the block's top."""
    steps = F.array(*(_sides(F.col(f"level{k}"), F.floor(place / ARITY**k).cast("int")) for k in range(CLIMB)))
    return F.slice(steps, F.lit(1), F.col("high"))


def _places() -> Column:
    """The places in a block; levels stay inside their row: only what a node needs leaves it."""
    return F.sequence(F.lit(0), F.size("rows") - 1)


def _folded(steps: Column, start: Column) -> Column:
    """The digest ``start`` led up along ``steps``, as bytes."""
    text = lambda b: F.lower(F.hex(b))
    return F.aggregate(steps, start, lambda h, s: F.unhex(digest(text(s["left"]), text(h), text(s["right"]))))


def _siblings(steps: Column, start: Column) -> Column:
    """``start`` followed by the siblings of ``steps``."""
    return F.aggregate(steps, start, lambda p, s: F.concat(p, s["left"], s["right"]))


def build(leaves: DataFrame, most: int, end: tuple[Column, Column]) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of every stage, tops) of trees over ``leaves`` (tree, idx, n, hash as bytes), ``n`` being a tree's leaves.

    ``most`` is the largest ``n``. Blocks are (tree, stage, block, n, rows, up_tree, up_stage, up_idx), the first ones of leaves, whose
    ``rows`` keep other columns of ``leaves``; the last block of a tree links to stage 0 of ``end``, a tree and an index. ``tops`` is (tree, hash).
    """
    stages, tops, nodes, stage = [], [], leaves, 0
    while True:
        blocks = materialise(_grouped(nodes), f"merkle{stage}")
        raised = materialise(_raised(blocks).select("tree", "block", "n", "top"), f"tops{stage}")
        done = F.col("n") <= BLOCK
        link = lambda here, up, done=done: F.when(done, here).otherwise(up)
        stages.append(
            blocks.select(
                "tree", F.lit(stage).alias("stage"), "block", "n", "rows",
                link(end[0], F.col("tree")).cast("long").alias("up_tree"), link(F.lit(0), F.lit(stage + 1)).alias("up_stage"),
                link(end[1], F.col("block")).cast("long").alias("up_idx"),
            )
        )
        tops.append(raised.where(done).select("tree", F.col("top").alias("hash")))
        if most <= BLOCK:
            break
        nodes = raised.where(~done).select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("top").alias("hash"))
        most, stage = -(-most // BLOCK), stage + 1
    return stages, _union(tops)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def node_rows(stages: list[DataFrame]) -> DataFrame:
    """Node rows of blocks: (tree, stage, idx, steps, up_tree, up_stage, up_idx)."""

    def rows(blocks: DataFrame) -> DataFrame:
        made = F.transform(_places(), lambda at: F.struct(F.get("rows", at)["idx"].alias("idx"), _steps(at).alias("steps")))
        return _raised(blocks).select("tree", "stage", "up_tree", "up_stage", "up_idx", F.inline(made))

    return _union([rows(blocks) for blocks in stages])


#: {start} holds blocks of leaves after their own link, {nodes} the stored nodes above them
CLIMB_SQL = """
WITH RECURSIVE climb(leaf_tree, block, tree, stage, idx, folded, proof) AS (
  SELECT tree, block, up_tree, up_stage, up_idx, folded, X'' FROM {start}
  UNION ALL
  SELECT %s c.leaf_tree, c.block, n.up_tree, n.up_stage, n.up_idx,
    transform(c.folded, f -> aggregate(n.steps, f, (acc, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(acc)), lower(hex(s.right))), 256)))),
    concat(c.proof, aggregate(n.steps, X'', (acc, s) -> concat(acc, s.left, s.right)))
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.stage = n.stage AND c.idx = n.idx
)
SELECT leaf_tree AS tree, block, folded, proof FROM climb WHERE tree = {above}
"""


def climb(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tree, block, folded, proof) of every block of leaves, by the recursive query: the digests that its leaves lead to at
    the root, and the siblings above the block. The result is written before it is returned.

    Up to 50,000 nodes (counted, about 450 bytes each) are sent to the tasks, more are shuffled. The number of rows of a recursion has no
    limit here, as every block adds one per link; the setting is put back.
    """
    spark, name = start.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(name)
    query = CLIMB_SQL % ("/*+ BROADCAST(n) */" if nodes.count() <= SENT_NODES else "")
    spark.conf.set(name, "-1")
    try:
        return materialise(spark.sql(query, start=start, nodes=nodes, above=ABOVE), "climb")
    finally:
        spark.conf.set(name, before)


def manifest(df: DataFrame, leaf: Column, tampered: Column | None = None, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(``key``, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``leaf`` is the digest of a row as lower-case hex, ``tampered`` the one to be proved (default: the same). Leaves of
    a source ascend by ``key``, nulls first, repeated keys by digest; a null source is a source, the first one. Repeated
    rows are leaves of their own, an empty table gives an empty result. Only digests and keys are moved, never texts.
    """
    tampered = leaf if tampered is None else tampered
    # empty bytes stand for a leaf that was not tampered with
    same = F.octet_length("folded") == 0
    rows = df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("src"), leaf.alias("leaf"), tampered.alias("folded"))
    rows = rows.select("key", "src", F.unhex("leaf").alias("hash"), F.when(F.col("leaf") == F.col("folded"), F.lit(b"")).otherwise(F.unhex("folded")).alias("folded"))
    whole = F.when(same, F.col("hash")).otherwise(F.col("folded"))
    rows = ranked(rows, ["src"], [c.asc_nulls_first() for c in (F.col("key"), F.col("hash"), whole)], "rank")
    totals = rows.groupBy("src").agg(F.count("*").alias("n"))
    sources = materialise(ranked(totals, [], [F.col("src").asc_nulls_first()], "place"), "sources")
    sources = sources.select(F.col("src").alias("__src"), "n", (F.col("place") - 1).alias("tree"))
    most, count = sources.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    join = lambda left, right, on: left.join(F.broadcast(right) if count <= 100_000 else right, on)
    leaves = join(rows, sources, F.col("src").eqNullSafe(F.col("__src")))
    leaves = leaves.select("tree", (F.col("rank") - 1).alias("idx"), "n", "hash", "key", "folded")
    (low, *higher), subroots = build(leaves, most, (F.lit(TOP), F.col("tree")))
    trees = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), "hash")
    top, roots = build(trees, count, (F.lit(ABOVE), F.lit(0)))
    root = F.lit(bytes(roots.first()["hash"]).hex() if count else None).cast("string")
    # leaves follow their own link here, so that the recursion joins with higher nodes only
    given = lambda at: F.get("rows", at)["folded"]
    begin = lambda at: F.when(F.octet_length(given(at)) == 0, F.get("rows", at)["hash"]).otherwise(given(at))
    hops = F.transform(_places(), lambda at: _folded(_steps(at), begin(at)))
    start = _raised(low).select("tree", "block", "up_tree", "up_stage", "up_idx", hops.alias("folded"))
    climbed = climb(start, materialise(node_rows([*higher, *top]), "nodes"))
    named = join(low.select("tree", "block", "n", "rows"), subroots.withColumnRenamed("hash", "subroot"), "tree")

    def proved(at: Column) -> Column:
        row, proof = F.get("rows", at), F.concat(_siblings(_steps(at), F.lit(b"")), F.col("proof"))
        return F.struct(
            row["key"].alias("key"), F.lower(F.hex(row["hash"])).alias("leaf"), F.lower(F.hex(F.get("folded", at))).alias("folded"),
            digest(F.lower(F.hex(proof))).alias("proof_sha256"),
        )

    out = _raised(named.join(climbed, ["tree", "block"])).select(F.lower(F.hex("subroot")).alias("subroot"), F.inline(F.transform(_places(), proved)))
    return out.select(
        F.col("key").alias(key), "leaf", "subroot", root.alias("root"), "proof_sha256",
        F.col("folded").alias("folded_root"), (F.col("folded") == root).alias("verified"),
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document whose id has an even crc32 is tampered with by deleting its line ends; a null id is left alone."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: digest(*(coded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), coded(text))
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, row(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).otherwise(row(F.col("text")))
    return manifest(docs, row(F.col("text")), tampered)


#: Trees by grouped levels, proofs level by level; crc32 by its table of 256 remainders.
OP12_SQL = """
WITH RECURSIVE
bits AS (SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
doc AS (
  SELECT doc_id, source, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')]),
      lambda a, x: xor(a >> 8, t[xor(a & 255, x) + 1])), 4294967295) % 2 = 0, false) AS even,
    concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body, replace(text, chr(10), '') AS cut
  FROM documents, crc),
leaf AS (
  SELECT doc_id, source, sha256(head || body) AS leaf,
    sha256(head || CASE WHEN even THEN coalesce(strlen(cut) || ':' || cut, '-') ELSE body END) AS bad FROM doc),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, bad) - 1 AS i FROM leaf),
low AS (
  SELECT source, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM placed
  UNION ALL
  SELECT DISTINCT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i) OVER (PARTITION BY source, i // 3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 2) // 3
  FROM low WHERE n > 1),
subroot AS (
  SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroot
  UNION ALL
  SELECT DISTINCT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i) OVER (PARTITION BY i // 3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), (n + 2) // 3
  FROM high WHERE n > 1),
walk AS (
  SELECT source, i AS doc, 0 AS level, i AS at, bad AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.source, w.doc, w.level + 1, w.at // 3,
    sha256(string_agg(CASE WHEN l.i = w.at THEN w.folded ELSE l.h END, '' ORDER BY l.i)),
    w.proof || coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i <> w.at), '')
  FROM walk w JOIN low l ON l.source IS NOT DISTINCT FROM w.source AND l.level = w.level AND l.i // 3 = w.at // 3 AND l.n > 1
  GROUP BY w.source, w.doc, w.level, w.at, w.folded, w.proof),
top AS (
  SELECT w.source, w.doc, 0 AS level, s.i AS at, w.folded, w.proof
  FROM walk w JOIN subroot s ON s.source IS NOT DISTINCT FROM w.source AND s.height = w.level
  UNION ALL
  SELECT w.source, w.doc, w.level + 1, w.at // 3,
    sha256(string_agg(CASE WHEN l.i = w.at THEN w.folded ELSE l.h END, '' ORDER BY l.i)),
    w.proof || coalesce(string_agg(l.h, '' ORDER BY l.i) FILTER (l.i <> w.at), '')
  FROM top w JOIN high l ON l.level = w.level AND l.i // 3 = w.at // 3 AND l.n > 1
  GROUP BY w.source, w.doc, w.level, w.at, w.folded, w.proof),
root AS (SELECT level AS height, h AS root FROM high WHERE n = 1)
SELECT p.doc_id, p.leaf, s.subroot, r.root, sha256(t.proof) AS proof_sha256, t.folded AS folded_root, t.folded = r.root AS verified
FROM placed p JOIN subroot s ON s.source IS NOT DISTINCT FROM p.source
JOIN root r ON true JOIN top t ON t.source IS NOT DISTINCT FROM p.source AND t.doc = p.i AND t.level = r.height
"""
