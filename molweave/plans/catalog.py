"""Every operator as a query over the test tables.

The tables hold no molecules, so they stand in for them: an embedding is a compound whose first 32
signs are its contacts and whose last 32 are its chemical bits, its first 63 values times 100 are 21 atoms whose charge is the last value, label 0
is the positive class, label 1 the negative one, and all other labels are base compounds. Docking logs are
texts made from events, bonded molecules are orders with their lines as atoms.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molweave.functions import text as tx
from molweave.functions.chem import element_of_type, vdw_radius
from molweave.functions.geometry import AXES, Box, crosses_line, distance, surface_gap
from molweave.functions.labels import compound_type, external_id, label_of
from molweave.functions.report import percent
from molweave.operators import clustering, contacts, docking, fingerprints, mass, patterns
from molweave.operators import ranking, selection, similarity, site, sparse
from molweave.plans import jobs, screening
from molweave.plans.counts import RunCounts
from molweave.session import materialise, scratch_path
from molweave.sinks import atoms as atom_sinks
from molweave.sinks import committed, tables
from molweave.sinks import text as text_sinks
from molweave.sources import docking_log, docking_results, elements, mol2, pdbqt, records, report
from molweave.sources import training, xyz

WIDTH = 32
BOX = Box((0.0, 0.0, 0.0), (30.0, 30.0, 30.0))
SITE_STEP = 0.5
ATOMS = 21
ELEMENT_KINDS = ("C", "N", "O", "S", "H", "F", "P", "Cl", "Br", "Zn")
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins


def _value(i: int) -> Column:
    return F.get("embedding", F.lit(i)).cast("double")


def _sign_word(first: int) -> Column:
    bits = (f"if(embedding[{first + i}] > 0, {1 << i}L, 0L)" for i in range(WIDTH))
    return F.expr(f"array({' | '.join(bits)})")


def compounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ord, label_id, name, contacts, chem, energy`` of every embedding."""
    prefix = F.when(F.col("label") == 0, "yes_").when(F.col("label") == 1, "not_").otherwise("ZINC")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("ord"),
        F.col("label").alias("label_id"),
        F.concat(prefix, F.col("vec_id").cast("string")).alias("name"),
        _sign_word(0).alias("contacts"),
        _sign_word(WIDTH).alias("chem"),
        F.round(-F.abs(_value(1)) * 100, 4).alias("energy"),
    )


def _space(df: DataFrame, space: str) -> DataFrame:
    return df.select("ord", "name", F.col(space).alias("words"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compounds(spark, sf_dir).where("label_id <= 1").withColumn("label", label_of(F.col("name")))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compounds(spark, sf_dir).where("label_id > 1")


def _element(label: Column) -> Column:
    return F.element_at(F.lit(list(ELEMENT_KINDS)), label + 1)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One atom per embedding, from its first three values."""
    element = _element(F.col("label"))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("atom_id"),
        *((_value(i) * 100).alias(c) for i, c in enumerate(AXES)),
        element.alias("element"),
        vdw_radius(element).alias("radius"),
        "label",
    )


def molecule_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """21 atoms per embedding as an array of atom lines, one row per molecule."""
    kinds = ",".join(f"'{k}'" for k in ELEMENT_KINDS)

    def atom(j: int) -> str:
        kind = f"array({kinds})[(label + {j}) % 10]"
        fields = {
            "serial": str(j + 1),
            "atom_name": f"concat({kind}, '{j + 1}')",
            **{c: f"cast(embedding[{3 * j + i}] as double) * 100" for i, c in enumerate(AXES)},
            "sybyl_type": f"concat({kind}, '{'.3' if j % 2 else ''}')",
            "resnum": str(j // 7 + 1),
            "resname": f"'RES{j // 7 + 1}'",
            "charge": f"cast(embedding[{3 * ATOMS}] as double)",
        }
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("mol_id"),
        F.concat(F.lit("mol_"), F.col("vec_id").cast("string")).alias("name"),
        F.expr(f"array({', '.join(atom(j) for j in range(ATOMS))})").alias("atoms"),
    )


def _bonded(molecules: DataFrame) -> DataFrame:
    bond = lambda i: F.struct(
        i.alias("bond_id"), i.alias("a"), (i + 1).alias("b"), F.when(i % 2 == 0, "2").otherwise("1").alias("btype")
    )
    return molecules.withColumn("bonds", F.transform(F.sequence(F.lit(1), F.lit(ATOMS - 1)), bond))


def _exploded(molecules: DataFrame) -> DataFrame:
    return molecules.select("mol_id", F.inline("atoms"))


def mol2_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The molecules written as MOL2 text and read back."""
    path = scratch_path(spark, "mol2")
    texts = text_sinks.mol2_text(_bonded(molecule_atoms(spark, sf_dir)))
    # in id order, so that file order is known
    texts.orderBy("mol_id").select("text").write.text(path)
    return mol2.read_mol2(spark, path)


def pdbqt_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models ``model_no, ligand, lines``; every fifth atom is a ``HETATM``."""
    line = F.transform(
        "atoms",
        lambda a, i: F.concat(
            F.when(i % 5 == 4, "HETATM").otherwise("ATOM  "),
            F.lpad(a["serial"].cast("string"), 5, " "),
            F.lit(" "),
            F.rpad(a["atom_name"], 4, " "),
            F.lit(" UNK A  0     "),
            F.format_string("%8.3f%8.3f%8.3f", a["x"], a["y"], a["z"]),
            F.lit("  0.00  0.00    +0.000 "),
            F.rpad(F.substring(a["atom_name"], 1, 2), 2, " "),
        ),
    )
    head = F.array(F.concat(F.lit(pdbqt.NAME_MARK), F.col("name")))
    return molecule_atoms(spark, sf_dir).select(
        F.col("mol_id").alias("model_no"), F.col("name").alias("ligand"), F.concat(head, line).alias("lines")
    )


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One docking log per event; its type decides how complete the log is."""
    energy = lambda i: F.round(F.lit(0.25 * (i - 1)) - F.col("value"), 2)
    row = lambda i, tail="": F.concat_ws(
        "   ", F.lit(f"  {i}"), energy(i).cast("string"), F.lit(f"{i - 1}.500"), F.lit(f"{i}.250{tail}")
    )
    kind = F.col("event_type")
    header = F.array(
        F.lit("Reading input ... done."),
        F.when(kind == "signup", "table |   affinity").otherwise("mode |   affinity | dist from best mode"),
        F.lit("     | (kcal/mol) | rmsd l.b.| rmsd u.b."),
        F.lit("-----+------------+----------+----------"),
    )
    body = F.array(row(1), row(2), F.when(kind == "error", F.lit("  3  12")).otherwise(row(3)), row(4))
    wanted = F.when(kind == "click", 2).otherwise(4)
    tail = F.when(kind == "view", F.array(F.lit("Stopped."))).otherwise(F.array(F.lit("Writing output ... done.")))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("lig_"), F.col("event_id").cast("string")).alias("ligand"),
        F.array_join(F.concat(header, F.slice(body, F.lit(1), wanted), tail), "\n").alias("value"),
    )


def bonded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as molecules of one row: all their lines, numbered, are atoms and neighbours are bonded."""
    line = F.struct("l_linenumber", "l_linestatus", "l_returnflag")
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("mol_id")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    atom = lambda x, i: F.struct((i + 1).alias("serial"), x["l_linestatus"].alias("element"))
    kind = lambda x: F.when(x["l_returnflag"] == "A", "1").when(x["l_returnflag"] == "N", "2").otherwise("ar")
    bond = lambda x, i: F.struct((i + 1).alias("a"), (i + 2).alias("b"), kind(x).alias("btype"))
    return grouped.select(
        "mol_id",
        F.transform("lines", atom).alias("atoms"),
        F.transform(F.slice("lines", 1, F.size("lines") - 1), bond).alias("bonds"),
    )


def _bit_text(words: str = "words", width: int = 2 * WIDTH) -> Column:
    """Set bits of a packed vector as text."""
    on = F.expr(
        f"filter(sequence(0, {width - 1}), b -> (shiftright(element_at({words}, cast(b div 64 as int) + 1), "
        "cast(b % 64 as int)) & 1L) = 1L)"
    )
    return F.array_join(on.cast("array<string>"), ",")


# --- similarity


def train_base_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = similarity.most_similar(
        _space(base(spark, sf_dir), "chem"), _space(labelled(spark, sf_dir), "chem"), 3
    )
    return best.select(
        "name",
        "other",
        F.col("rank").cast("int").alias("rank"),
        F.round("sim", 6).alias("sim"),
        percent(F.col("sim")).alias("percent"),
    )


def train_base_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.similarity_pairs(
        _space(labelled(spark, sf_dir), "contacts"), _space(base(spark, sf_dir), "contacts"), digits=6
    )


def train_base_topk_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index of the labelled compounds, which is searched outward by bit count."""
    path = scratch_path(spark, "index")
    sparse.write_index(_space(labelled(spark, sf_dir), "chem"), path)
    best = sparse.most_similar_indexed(_space(base(spark, sf_dir), "chem"), sparse.read_index(spark, path), 3)
    return best.select("name", "other", "rank", F.round("sim", 6).alias("sim"), percent(F.col("sim")).alias("percent"))


def _order_vectors(spark: SparkSession, sf_dir: str, mine: Column | None = None) -> DataFrame:
    """Different circular fingerprints of orders, 1,024 bits wide: ``ord`` (the first order with it), ``words``; with ``mine``
    those of orders for which it holds and those of all others, told apart by a column ``mine``."""
    molecules = bonded_orders(spark, sf_dir)
    side = []
    if mine is not None:
        # an order of which it is not known belongs to neither
        known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("mol_id"), mine.alias("mine")).where("mine is not null")
        molecules, side = molecules.join(known, "mol_id"), ["mine"]
    # equal molecules have equal fingerprints, so each is made once
    different = molecules.groupBy("atoms", "bonds", *side).agg(F.min("mol_id").alias("mol_id"))
    found = fingerprints.record_fingerprints(different, ["mol_id", *side])
    return materialise(found.groupBy("words", *side).agg(F.min("mol_id").alias("ord")).select("ord", "words", *side), "orders")


def sparse_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent unfinished orders against all others by postings of 1,024 bits: a summary of each one's row of the matrix."""
    mine = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    vectors = _order_vectors(spark, sf_dir, mine)
    rows = sparse.sparse_pairs(vectors.where("mine").drop("mine"), vectors.where("not mine").drop("mine"), summary=True)
    return rows.select(
        F.col("left_ord").alias("ord"), "pairs", "shared",
        F.round("max_sim", 6).alias("max_sim"), F.round("sum_sim", 4).alias("sum_sim"),
    )


def similar_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different order fingerprints with a similarity of 0.6 or more."""
    pairs = sparse.similar_above(_order_vectors(spark, sf_dir), 0.6)
    return pairs.select("a", "b", F.round("sim", 6).alias("sim"))


def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, other = (_space(f(spark, sf_dir), "chem") for f in (base, labelled))
    stats = similarity.similarity_stats(mine, other)
    return stats.select("name", F.round("max_sim", 6).alias("max_sim"), F.round("avg_sim", 6).alias("avg_sim"))


def all_pairs_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.distance_pairs(_space(compounds(spark, sf_dir), "chem"), digits=6).select("a", "b", "sim", "dist")


def lower_triangle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _space(compounds(spark, sf_dir), "contacts")
    return similarity.lower_triangle_lines(vectors)


def blended_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = compounds(spark, sf_dir).select("ord", "name", F.col("chem").alias("words"), F.col("contacts").alias("words2"))
    return similarity.blended_pairs(vectors, 0.5, digits=6).select("a", "b", "dist")


def concat_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compounds(spark, sf_dir)
    tag = F.concat_ws("_", F.lit("any"), F.col("ord").cast("string"), F.col("label_id").cast("string"))
    chem = _space(rows.withColumn("name", tag), "chem")
    both = fingerprints.concat_by_containment(chem, _space(rows, "contacts"), WIDTH, WIDTH)
    return both.select("name", _bit_text().alias("bits"))


def concat_by_exact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compounds(spark, sf_dir).withColumn("ext_id", F.col("ord").cast("string"))
    chem, box = (rows.select("ext_id", "ord", "name", F.col(s).alias("words")) for s in ("chem", "contacts"))
    both = fingerprints.concat_by_id(chem, box, WIDTH, WIDTH)
    return both.select("name", _bit_text().alias("bits"))


def _class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(F.col("label_id").cast("bigint").alias("subset"), "name")


def mean_similarity_top_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = _space(base(spark, sf_dir), "chem")
    top = selection.top_of_members(mine, _space(labelled(spark, sf_dir), "chem"), _class_members(spark, sf_dir), mine.count(), 10)
    return top.select("subset", "name", F.round("avg_sim", 6).alias("avg_sim"))


def isolated_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per class the best matches of each member: 150 percent of the base over the class size, 10 at least."""
    mine = _space(base(spark, sf_dir), "chem")
    return selection.isolated_top(
        _space(labelled(spark, sf_dir), "chem"), mine, _class_members(spark, sf_dir), 150, mine.count()
    )


# --- geometry


def box_filter_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = contacts.box_atoms(_exploded(molecule_atoms(spark, sf_dir)), BOX)
    ends = contacts.bounds(inside)
    return ends.select("mol_id", *(F.round(f"{n}{c}", 6).alias(f"{n}{c}") for n in ("min", "max") for c in AXES))


def nearest_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest distance of every molecule to the site, and the site atom it leads to."""
    found = contacts.nearest_site_atoms(_exploded(molecule_atoms(spark, sf_dir)), _site(spark, sf_dir))
    return found.select("mol_id", "bit", F.round("distance", 6).alias("distance"))


def box_atoms_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms in a box from a table stored along a space-filling curve."""
    path = scratch_path(spark, "atoms")
    atom_sinks.write_atom_table(_exploded(molecule_atoms(spark, sf_dir)).select("mol_id", "serial", *AXES), path, 1 << 16)
    return atom_sinks.read_box(spark, path, BOX).select("mol_id", "serial", *(F.round(c, 6).alias(c) for c in AXES))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of protein, box and site atoms and of molecules, observed while site and fingerprints are made."""
    counts, every = RunCounts(), F.count(F.lit(1))
    atoms = counts.watch(points(spark, sf_dir), protein_atoms=every, box_atoms=F.count_if(BOX.contains()))
    scored = materialise(site.sweep_scores(atoms, BOX, SITE_STEP), "scores")
    where = materialise(counts.watch(site.select_site(scored), site_atoms=every), "site")
    packed = contacts.contact_fingerprints(_exploded(molecule_atoms(spark, sf_dir)), where, max(1, where.count()))
    materialise(counts.watch(packed, molecules=every), "contacts")
    return counts.table(spark)


def committed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance matrix with its count line as a committed output: a write of which a task fails shows nothing, the
    next one all."""
    path = scratch_path(spark, "matrix")
    vectors = materialise(_space(labelled(spark, sf_dir), "contacts"), "vectors")
    lines = similarity.lower_triangle_lines(vectors, ordered=True)
    last = vectors.agg(F.max("ord")).first()[0]
    broken = F.when(F.col("ord") == last, F.raise_error(F.lit("a task fails"))).otherwise(F.col("line"))
    try:
        committed.write_committed(lines.select(broken.alias("line")), path, count_line=True)
    except (PySparkException, Py4JJavaError):
        pass
    if committed.committed_parts(path) is not None:
        raise AssertionError("a failed write must not show")
    committed.write_committed(lines.select("line"), path, count_line=True)
    return committed.read_committed(spark, path)


def committed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered models as a committed output: numbers must follow one another over all parts."""
    path = scratch_path(spark, "models")
    numbered = text_sinks.numbered_models(pdbqt_models(spark, sf_dir), ["ligand"]).orderBy("number")
    committed.write_committed(numbered.select("number", F.col("text").alias("line")), path)
    models = pdbqt.read_pdbqt(spark, committed.committed_parts(path))
    return models.select("ligand", F.size("lines").alias("lines"))


def box_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contacts.box_quality(points(spark, sf_dir), BOX)


def box_xyz_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = points(spark, sf_dir).withColumns({c: F.round(c, 3) for c in AXES})
    return text_sinks.xyz_lines(given, BOX)


def xyz_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.transform("atoms", lambda a: F.concat_ws("\t", a["sybyl_type"], a["x"].cast("string"), a["y"].cast("string"), a["z"].cast("string")))
    texts = molecule_atoms(spark, sf_dir).select(
        "name",
        F.array_join(F.concat(F.array(F.size("atoms").cast("string"), F.col("name")), line), "\n").alias("value"),
    )
    atoms = xyz.parse_xyz(texts)
    return atoms.select("name", "line_no", "element", "radius", "resname", *(F.round(c, 6).alias(c) for c in AXES))


def atom_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First two atoms of every molecule: distance, surface gap, and whether the first one's shadow
    covers the axis-parallel lines through the second."""
    atoms = F.col("atoms")
    with_radius = lambda i: atoms[i].withField(
        "radius", vdw_radius(element_of_type(atoms[i]["sybyl_type"]))
    )
    pairs = molecule_atoms(spark, sf_dir).select("mol_id", with_radius(0).alias("p"), with_radius(1).alias("q"))
    near = pairs.select("mol_id", "p", "q", "p.*")
    crossing = {
        f"crosses_{axis}": crosses_line(a, b, F.col(f"q.{a}") / 4, F.col(f"q.{b}") / 4)
        for axis, a, b in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))
    }
    return near.select(
        "mol_id",
        F.round(distance("p", "q"), 6).alias("distance"),
        F.round(surface_gap("p", "q"), 6).alias("gap"),
        *(value.alias(name) for name, value in crossing.items()),
    )


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of the labelled compounds inside the box, numbered."""
    inside = contacts.box_atoms(points(spark, sf_dir).where("label <= 1"), BOX)
    return materialise(site.number_bits(inside), "site")


def contact_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = _exploded(molecule_atoms(spark, sf_dir))
    return contacts.contact_pairs(atoms, _site(spark, sf_dir), once=True)


def contact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = molecule_atoms(spark, sf_dir).select("name", F.inline("atoms"))
    where = _site(spark, sf_dir)
    width = max(1, where.count())
    packed = contacts.contact_fingerprints(atoms, where, width, by=("name",))
    return fingerprints.bit_text(packed, ["name"], width)


def _sweep(mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = site.sweep_scores(points(spark, sf_dir), BOX, SITE_STEP, mode=mode)
        return scored.select("atom_id", "score")

    return query


def cavity_sweep_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = materialise(site.sweep_scores(points(spark, sf_dir), BOX, SITE_STEP), "scores")
    return site.select_site(scored).select("atom_id", "score", "bit")


# --- patterns and scores


def _pattern(spark: SparkSession, sf_dir: str, kind: int = patterns.ONE_MINUS_MAX) -> DataFrame:
    return patterns.class_pattern(labelled(spark, sf_dir), WIDTH, kind)


def _class_pattern(kind: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pattern(spark, sf_dir, kind).select("label", "bit", F.round("weight", 6).alias("weight"))

    return query


def _net_scores(spark: SparkSession, sf_dir: str, chosen: DataFrame | None = None) -> DataFrame:
    vectors = _space(base(spark, sf_dir), "contacts")
    if chosen is not None:  # nobody asks for the scores of others
        vectors = vectors.join(chosen.select("name"), "name", "left_semi")
    return patterns.net_scores(patterns.pattern_scores(vectors, _pattern(spark, sf_dir)))


def _energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select(F.col("name").alias("ligand"), "energy")


def net_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = tables.scores_table(_net_scores(spark, sf_dir), _energies(spark, sf_dir))
    return scores.select("Id", F.round("Score", 6).alias("Score"), "Energy").orderBy(F.desc("Score"), "Id")


def essential_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = materialise(_pattern(spark, sf_dir), "pattern")
    bits = spark.range(WIDTH).select(F.col("id").cast("int").alias("bit"))
    named = bits.select(
        "bit",
        F.concat(F.lit("R"), F.floor(F.col("bit") / 8).cast("string")).alias("resname"),
        F.concat(F.lit("A"), F.lpad(F.col("bit").cast("string"), 2, "0")).alias("atom_name"),
    )
    groups = patterns.essential_residues(pattern, named, WIDTH, 1.05)
    return groups.select("resname", F.array_join("atoms", ",").alias("atoms"))


def bit_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = materialise(_pattern(spark, sf_dir), "pattern")
    diffs = patterns.bit_differences(pattern, WIDTH, 1.05)
    return diffs.select("bit", *(F.round(c, 6).alias(c) for c in ("yes", "no", "diff")))


# --- trees and the screen


def _tree(spark: SparkSession, sf_dir: str, space: str, linkage: str = "weighted", **how: int) -> DataFrame:
    leaves = _space(labelled(spark, sf_dir), space)
    return clustering.tree_of_vectors(leaves.withColumn("tree", F.lit(0)), linkage, **how)


def _merges(spark: SparkSession, tree: DataFrame) -> DataFrame:
    merges = clustering.inner_nodes(tree)
    return merges.select("node", "left", "right", "size", F.round("height", 6).alias("height"))


def tree_merges(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    return _merges(spark, _tree(spark, sf_dir, "contacts", **how))


def tree_merges_by_size(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    return _merges(spark, _tree(spark, sf_dir, "chem", "average", **how))


def clades(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    tree = materialise(_tree(spark, sf_dir, "contacts", **how), "tree")
    return clustering.node_members(tree, clustering.inner_nodes(tree)).select("node", "name")


def clade_table(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    """Inner nodes in post-order with their interval of leaves: one row each."""
    nodes = clustering.inner_nodes(_tree(spark, sf_dir, "contacts", **how))
    return nodes.select("place", "node", "left", "right", "first", "size")


def yes_clades(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    tree = materialise(_tree(spark, sf_dir, "contacts", **how), "tree")
    return clustering.positive_nodes(tree, 70).select("node", F.round("share", 6).alias("share"), "size")


def _in_rounds(query: Callable[..., DataFrame], **how: int) -> Query:
    """A tree query by rounds of mutual nearest neighbours, until half of the clusters are left, or as few as one task takes."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(spark, sf_dir, local_leaves=1, hand_over=labelled(spark, sf_dir).count() // 2, **how)

    return run


def clade_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    _members, found = screening.clade_candidates(
        _space(labelled(spark, sf_dir), "chem"), _space(base(spark, sf_dir), "chem"), 75, 2
    )
    return found.select("subset", "name", F.round("avg_sim", 6).alias("avg_sim"))


def concatenated_tree(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    rows = labelled(spark, sf_dir)
    chem = _space(rows.withColumn("name", F.concat("name", F.lit("_x"))), "chem")
    tree = jobs.concatenated_tree(chem, _space(rows, "contacts"), WIDTH, WIDTH, **how)
    return _merges(spark, tree)


def blended_tree(spark: SparkSession, sf_dir: str, **how: int) -> DataFrame:
    rows = labelled(spark, sf_dir)
    return _merges(spark, jobs.blended_tree(_space(rows, "chem"), _space(rows, "contacts"), 0.5, **how))


def _screened(spark: SparkSession, sf_dir: str, settings: screening.Screen = screening.Screen()) -> DataFrame:
    train, mine = labelled(spark, sf_dir), base(spark, sf_dir)
    return screening.two_level_candidates(
        _space(train, "contacts"),
        _space(train, "chem"),
        _space(mine, "contacts"),
        _space(mine, "chem"),
        _energies(spark, sf_dir),
        settings,
    )


def isolated_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The screen by each member's own best matches instead of the mean similarity to its clade."""
    found = _screened(spark, sf_dir, screening.Screen(isolated=True))
    return found.select("subset", "name", "energy", F.col("rank").cast("int").alias("rank"))


def two_level_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _screened(spark, sf_dir).select("subset", "name", "energy", F.col("rank").cast("int").alias("rank"))


def cluster_best_by_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = ranking.first_per_group(base(spark, sf_dir), ["label_id"], [F.asc("energy"), F.asc("name")], 30)
    return screening.winners(best).orderBy("energy", "name")


def _records(spark: SparkSession, sf_dir: str, chosen: DataFrame, shown: int | None) -> DataFrame:
    train, mine = labelled(spark, sf_dir), base(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ext_id"), F.col("p_name").alias("long_name")
    )
    return screening.report_records(
        chosen,
        _net_scores(spark, sf_dir, chosen),
        _space(mine, "chem"),
        _space(train, "chem"),
        _space(mine, "contacts"),
        _space(train, "contacts"),
        training.with_long_names(train.select("name"), names),
        shown,
    )


def _similar_text(column: str) -> Column:
    entry = lambda e: F.concat_ws(
        ":", e["id"], e["type"], F.coalesce(e["longname"], F.lit("")), e["similarity"].cast("string")
    )
    return F.array_join(F.transform(column, entry), ";").alias(column)


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report over all base compounds: the 150 best energies with their 3 most similar in each space."""
    chosen = screening.first_by_energy(base(spark, sf_dir).select("name", "energy"))
    out = screening.report_table(_records(spark, sf_dir, materialise(chosen, "chosen"), 3))
    return out.select(
        "id", "energy", F.round("score", 6).alias("score"), "band", "image",
        _similar_text("similarContacts"), _similar_text("similarChem"),
    )


def screen_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way: screen, report records saved as JSON, read back."""
    chosen = materialise(screening.winners(_screened(spark, sf_dir)), "winners")
    path = scratch_path(spark, "report")
    tables.write_report(_records(spark, sf_dir, chosen, 3), path)
    saved = report.read_report(spark, path)
    return saved.select(
        "id", "energy", F.round("score", 6).alias("score"),
        _similar_text("similarContacts"), _similar_text("similarChem"),
    )


# --- files and docking output


def molecule_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    atoms = lines.select(
        F.col("l_orderkey").alias("mol_id"), F.explode(F.array("l_returnflag", "l_linestatus")).alias("element")
    )
    found = mass.masses(atoms, elements.load_elements(spark))
    return found.select("mol_id", F.round("mass", 6).alias("mass"))


def residue_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = _exploded(molecule_atoms(spark, sf_dir)).withColumn("element", element_of_type(F.col("sybyl_type")))
    found = mass.masses(atoms, elements.load_elements(spark), ["mol_id", "resnum", "resname"])
    return found.select("mol_id", "resnum", "resname", F.round("mass", 6).alias("mass"))


def unknown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    atoms = lines.select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("element"))
    return mass.unknown_elements(atoms, elements.load_elements(spark))


def docking_log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = docking_log.parse_logs(log_texts(spark, sf_dir))
    return docking.docking_summary(logs, keep=("finished", "ok"))


def docking_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docking_log.mode_rows(docking_log.parse_logs(log_texts(spark, sf_dir)))


def docking_results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary written as a table and read back as docking results."""
    path = scratch_path(spark, "summary")
    tables.write_docking_summary(docking_log.parse_logs(log_texts(spark, sf_dir)), path)
    return docking_results.read_docking_results(spark, path)


def docking_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs folded into the summary by the streaming intake."""
    from molweave.streaming.intake import append_summary

    source, out, checkpoint = (scratch_path(spark, n) for n in ("logs", "stream", "offsets"))
    texts = log_texts(spark, sf_dir)
    texts.write.parquet(source)
    arriving = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", 4).parquet(source)
    append_summary(docking_log.parse_logs(arriving).drop("value"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def first_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First logs by the stateful intake, from text files in two lots with a restart between them.

    A user is a ligand. Its first event's log comes in the first lot unless that event is a signup, its last event's
    log in the second.
    """
    from molweave.streaming.intake import append_summary, stream_first_logs

    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "offsets")
    ends = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.min(F.struct("event_id", "event_type")).alias("first"), F.max("event_id").alias("last")
    )
    texts = log_texts(spark, sf_dir).withColumn("event_id", F.substring("ligand", 5, 20).cast("bigint"))
    named = lambda who, at: who.select(F.concat(F.lit("lig_"), F.col("user_id").cast("string"), F.lit("_out.log")).alias("name"), at.alias("event_id"))
    lots = (
        named(ends.where("first.event_type <> 'signup'"), F.col("first.event_id")),
        named(ends, F.col("last")),
    )
    folder = scratch_path(spark, "logs")
    for number, lot in enumerate(lots):
        text_sinks.write_texts(lot.join(texts, "event_id"), f"{folder}/lot{number}")
        append_summary(stream_first_logs(spark, f"{folder}/*"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


def first_pose_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First poses by the stateful intake: PDBQT files of two lots, the second with other poses of the same ligands."""
    from molweave.streaming.intake import append_table, stream_first_poses

    folder, out, checkpoint = (scratch_path(spark, n) for n in ("poses", "stream", "offsets"))
    models = pdbqt_models(spark, sf_dir)
    for number, lot in enumerate((models, models.withColumn("lines", F.slice("lines", 1, 3)))):
        text_sinks.write_models(lot, f"{folder}/lot{number}", ["model_no"])
        append_table(stream_first_poses(spark, f"{folder}/*"), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("ligand", F.size("lines").alias("lines"), F.get("lines", F.lit(1)).alias("second"))


def xyz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules written as XYZ files, one each of every label's first, read back."""
    line = F.transform("atoms", lambda a: F.concat_ws("\t", a["sybyl_type"], a["x"].cast("string"), a["y"].cast("string"), a["z"].cast("string")))
    body = F.array_join(F.concat(F.array(F.size("atoms").cast("string"), F.col("name")), line), "\n")
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("mol_id"))
    texts = molecule_atoms(spark, sf_dir).join(first, "mol_id").select(F.concat("name", F.lit(".xyz")).alias("name"), body.alias("value"))
    folder = scratch_path(spark, "xyz")
    text_sinks.write_texts(texts, folder)
    atoms = xyz.read_xyz(spark, folder)
    return atoms.select(tx.path_parts(F.col("src_file"))["stem"].alias("name"), "line_no", "element", *(F.round(c, 6).alias(c) for c in AXES))


def score_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score table as the screening job writes it, read back."""
    path = scratch_path(spark, "scores")
    tables.write_scores(_net_scores(spark, sf_dir), _energies(spark, sf_dir), path)
    saved = spark.read.csv(path, sep="\t", header=True, schema="Id string, Score double, Energy double")
    return saved.select("Id", F.round("Score", 6).alias("Score"), "Energy")


def distance_matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance matrix of the labelled compounds as it is written, with its count line."""
    path = scratch_path(spark, "matrix")
    text_sinks.write_distance_matrix(_space(labelled(spark, sf_dir), "contacts"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def docking_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses written as PDBQT files, two for every ligand, collected: first pose of each, numbered."""
    source, out = scratch_path(spark, "poses"), scratch_path(spark, "collected")
    models = pdbqt_models(spark, sf_dir)
    second = models.select((F.col("model_no") + 1_000_000_000).alias("model_no"), "ligand", F.slice("lines", 1, 3).alias("lines"))
    text_sinks.write_models(models.unionByName(second), source, ["model_no"])
    placed = materialise(records.with_place(pdbqt.read_pdbqt(spark, source)), "placed")
    first = docking.first_pose(placed.select("ligand", "ord", "lines"), order="ord")
    text_sinks.write_models(first, out, ["ligand"])
    return pdbqt.read_pdbqt(spark, out).select("ligand", F.size("lines").alias("lines"))


def first_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ligand"), F.col("event_id").alias("model_no"), "value"
    )
    return docking.first_pose(models)


def last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("name"), F.col("event_id").alias("ord"), "value"
    )
    return ranking.last_by_name(rows)


def _named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' molecules with their name in the key, so that nothing is joined back to them."""
    return mol2_files(spark, sf_dir).withColumn("mol_id", F.struct("mol_id", "name"))


def mol2_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = mol2.read_atoms(_named_files(spark, sf_dir))
    return atoms.select(
        "mol_id.name", "serial", "atom_name", *(F.round(c, 6).alias(c) for c in AXES),
        "sybyl_type", "resnum", "resname", "charge", "element", "radius",
    )


def mol2_bonds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mol2.read_bonds(_named_files(spark, sf_dir)).select("mol_id.name", "bond_id", "a", "b", "btype")


def skip_and_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip the first 10 molecules of the files, then read at most 20."""
    rest = records.skip_records(mol2_files(spark, sf_dir), 10)
    return records.first_records(rest, 20).select("name")


def pdbqt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models written into one PDBQT text, read back and weighed."""
    path = scratch_path(spark, "pdbqt")
    text_sinks.write_models(pdbqt_models(spark, sf_dir), path, ["model_no"])
    weighed = mass.pdbqt_masses(pdbqt.read_pdbqt(spark, path), elements.load_elements(spark))
    return weighed.select("ligand", F.round("mass", 6).alias("mass"))


def mass_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass table of a PDBQT file as the job writes it."""
    path, out = scratch_path(spark, "pdbqt"), scratch_path(spark, "masses")
    text_sinks.write_models(pdbqt_models(spark, sf_dir), path, ["model_no"])
    jobs.mass_job(spark, path, out)
    saved = spark.read.csv(out, sep="\t", header=True, schema="Ligand string, Mass double")
    return saved.select("Ligand", F.round("Mass", 6).alias("Mass"))


def rejected_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom lines of the MOL2 files that are no atoms: every seventh one gets a broken number."""
    broken = lambda a, i: F.when(i % 7 == 6, a.withField("sybyl_type", F.concat(a["sybyl_type"], F.lit(" x ")))).otherwise(a)
    path = scratch_path(spark, "mol2")
    molecules = molecule_atoms(spark, sf_dir).withColumn("atoms", F.transform("atoms", broken))
    text_sinks.mol2_text(_bonded(molecules)).select("text").write.text(path)
    read = mol2.read_mol2(spark, path).withColumn("mol_id", F.struct("mol_id", "name"))
    return mol2.rejected_atoms(read).select("mol_id.name", F.col("line_no").cast("int").alias("line_no"))


def repeated_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that an element list made of order lines has more than once."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ord"), F.concat_ws("\t", F.lit("x"), "l_returnflag", "l_linenumber", F.lit("1.5")).alias("line")
    )
    return elements.repeated_elements(lines)


def numbered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = text_sinks.numbered_models(pdbqt_models(spark, sf_dir), ["ligand"])
    lines = F.split("text", "\n")
    return models.select("number", lines[0].alias("first"), lines[1].alias("second"), F.size(lines).alias("lines"))


def training_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ext_id"), F.col("p_name").alias("long_name"), "p_type"
    )
    economy = F.col("p_type") == "ECONOMY"
    named = training.training_set(parts.where(economy), parts.where(~economy), long_names=True, clean=True)
    return named.select("name", "label")


def long_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("ext_id"), F.col("p_name").alias("long_name")
    )
    return training.with_long_names(compounds(spark, sf_dir).select("name"), names)


def selected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the labelled compounds, listed by energy, that also are in the box list."""
    rows = compounds(spark, sf_dir)
    listed = rows.where("label_id <= 1").select("name", F.col("energy").alias("pos"))
    chosen = similarity.select_by_names(_space(rows, "chem"), listed)
    inside = contacts.box_atoms(points(spark, sf_dir), BOX).select(F.col("atom_id").alias("ord"))
    other = rows.join(inside, "ord", "left_semi")
    return similarity.keep_present(chosen, other).select("name", "pos", _bit_text(width=WIDTH).alias("bits"))


def path_and_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        tx.path_parts(url)["directory"].alias("directory"),
        tx.path_parts(url)["stem"].alias("stem"),
        tx.path_parts(url)["extension"].alias("extension"),
        F.array_join(tx.tokens(url, "/?&=."), "|").alias("tokens"),
        tx.first_identifier(F.substring(url, 8, 2147483647)).alias("identifier"),
        tx.lenient_double(url).alias("number"),
        tx.lenient_int(url).alias("whole"),
        tx.ascii_lower(url).alias("lowered"),
    )


def name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.when(F.col("p_size") > 25, "YES_").otherwise("not_")
    name = F.concat(prefix, F.col("p_partkey").cast("string"), F.lit("_"), F.col("p_name"))
    price = F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf_dir, "part").select(
        name.alias("name"),
        label_of(name).alias("label"),
        external_id(name).alias("ext_id"),
        compound_type(name).alias("kind"),
        tx.short_id(name).alias("short"),
        tx.clean_name(name).alias("cleaned"),
        tx.base_id(F.concat(F.lit("ZINC"), F.col("p_partkey").cast("string"))).alias("base"),
        tx.decimal_comma(price).alias("price"),
        tx.is_letter(F.substring("p_name", 1, 1)).alias("letter"),
        tx.is_digit(F.substring(F.col("p_partkey").cast("string"), 1, 1)).alias("digit"),
    )


def circular_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.record_fingerprints(bonded_orders(spark, sf_dir), ["mol_id"])
    return fingerprints.unpack_bits(found, 1024, ["mol_id"])


QUERIES: dict[str, Query] = {
    "train_base_topk": train_base_topk,
    "train_base_matrix": train_base_matrix,
    "train_base_topk_indexed": train_base_topk_indexed,
    "sparse_similarity": sparse_similarity,
    "similar_above_threshold": similar_above_threshold,
    "similarity_stats": similarity_stats,
    "all_pairs_distance": all_pairs_distance,
    "lower_triangle_rows": lower_triangle_rows,
    "blended_similarity": blended_similarity,
    "concat_fingerprint": concat_fingerprint,
    "concat_by_exact_id": concat_by_exact_id,
    "mean_similarity_top_percent": mean_similarity_top_percent,
    "isolated_top": isolated_top,
    "box_filter_bounds": box_filter_bounds,
    "nearest_site": nearest_site,
    "box_atoms_stored": box_atoms_stored,
    "run_counts": run_counts,
    "committed_matrix": committed_matrix,
    "committed_models": committed_models,
    "box_quality": box_quality,
    "box_xyz_lines": box_xyz_lines,
    "xyz_parse": xyz_parse,
    "atom_geometry": atom_geometry,
    "contact_join": contact_join,
    "contact_fingerprint": contact_fingerprint,
    "cavity_sweep_scores": _sweep("reference"),
    "cavity_sweep_clean": _sweep("clean"),
    "cavity_sweep_sites": cavity_sweep_sites,
    "class_pattern_count": _class_pattern(patterns.COUNT),
    "class_pattern_mean": _class_pattern(patterns.ONE_MINUS_MEAN),
    "class_pattern_max": _class_pattern(patterns.ONE_MINUS_MAX),
    "net_score": net_score,
    "essential_groups": essential_groups,
    "bit_differences": bit_differences,
    "tree_merges": tree_merges,
    "tree_merges_by_size": tree_merges_by_size,
    "clades": clades,
    "yes_clades": yes_clades,
    "clade_table": clade_table,
    "clade_table_rounds": _in_rounds(clade_table, block_rows=64),
    "tree_merges_rounds": _in_rounds(tree_merges, block_rows=64),
    "tree_merges_by_size_rounds": _in_rounds(tree_merges_by_size, block_rows=64),
    "clades_rounds": _in_rounds(clades, block_rows=64),
    "yes_clades_rounds": _in_rounds(yes_clades, block_rows=64),
    "concatenated_tree_rounds": _in_rounds(concatenated_tree, block_rows=64),
    "blended_tree_rounds": _in_rounds(blended_tree),
    "clade_candidates": clade_candidates,
    "isolated_screen": isolated_screen,
    "concatenated_tree": concatenated_tree,
    "blended_tree": blended_tree,
    "two_level_screen": two_level_screen,
    "cluster_best_by_energy": cluster_best_by_energy,
    "report_table": report_table,
    "screen_report": screen_report,
    "molecule_mass": molecule_mass,
    "residue_mass": residue_mass,
    "unknown_elements": unknown_elements,
    "docking_log_parse": docking_log_parse,
    "docking_modes": docking_modes,
    "docking_results_table": docking_results_table,
    "docking_stream": docking_stream,
    "first_log_stream": first_log_stream,
    "first_pose_stream": first_pose_stream,
    "xyz_files": xyz_files,
    "score_file": score_file,
    "distance_matrix_file": distance_matrix_file,
    "docking_collection": docking_collection,
    "first_pose": first_pose,
    "last_duplicate": last_duplicate,
    "mol2_roundtrip": mol2_roundtrip,
    "mol2_bonds": mol2_bonds,
    "skip_and_first": skip_and_first,
    "pdbqt_roundtrip": pdbqt_roundtrip,
    "mass_file": mass_file,
    "rejected_atoms": rejected_atoms,
    "repeated_elements": repeated_elements,
    "numbered_models": numbered_models,
    "training_names": training_names,
    "long_names": long_names,
    "selected_vectors": selected_vectors,
    "path_and_name_parts": path_and_name_parts,
    "name_parts": name_parts,
    "circular_fingerprint": circular_fingerprint,
}
