"""Plain SQL statements of the catalog queries, for an independent engine to check them against.

They are written for clarity: theta joins, one merge per recursion step, brute force over all pairs.
"""

from __future__ import annotations

from molweave.constants import COMPOUND_IMAGE, ELEMENTS_TSV, LIGAND_IMAGE, VDW_RADII

# --- shared pieces

_COMPOUNDS = """
c AS (
  SELECT vec_id AS ord, label AS label_id, embedding,
         CASE label WHEN 0 THEN 'yes_' WHEN 1 THEN 'not_' ELSE 'ZINC' END || CAST(vec_id AS VARCHAR) AS name,
         round(-abs(CAST(embedding[2] AS DOUBLE)) * 100, 4) AS energy
  FROM embeddings),
signs AS (SELECT ord, i - 1 AS pos FROM c, range(1, 65) t(i) WHERE embedding[i] > 0),
v AS (
  SELECT c.ord, c.label_id, c.name, c.energy,
         CASE c.label_id WHEN 0 THEN 'yes' WHEN 1 THEN 'not' END AS label,
         CAST(coalesce(sum(CASE WHEN pos < 32 THEN CAST(1 AS BIGINT) << pos END), 0) AS BIGINT) AS con,
         CAST(coalesce(sum(CASE WHEN pos >= 32 THEN CAST(1 AS BIGINT) << (pos - 32) END), 0) AS BIGINT) AS chem
  FROM c LEFT JOIN signs s ON s.ord = c.ord GROUP BY ALL)
"""


def _sim(a: str, b: str) -> str:
    # an outer join's missing side gives null
    return (
        f"CASE WHEN ({a} | {b}) = 0 THEN CAST(1 AS DOUBLE) "
        f"ELSE CAST(bit_count({a} & {b}) AS DOUBLE) / bit_count({a} | {b}) END"
    )


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p.strip() for p in parts) + "\n"


def _element(label: str) -> str:
    return f"(['C','N','O','S','H','F','P','Cl','Br','Zn'])[({label}) % 10 + 1]"


def _radius(element: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in VDW_RADII.items())
    return f"CASE {element} {cases} ELSE CAST({VDW_RADII['C']} AS DOUBLE) END"


_POINTS = f"""
points AS (
  SELECT vec_id AS atom_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x,
         CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS z,
         {_element('label')} AS element, {_radius(_element('label'))} AS radius
  FROM embeddings)
"""
_IN_BOX = "x BETWEEN -15 AND 15 AND y BETWEEN -15 AND 15 AND z BETWEEN -15 AND 15"

_ATOMS = f"""
atoms AS (
  SELECT vec_id AS mol_id, 'mol_' || CAST(vec_id AS VARCHAR) AS name, CAST(j + 1 AS INTEGER) AS serial,
         {_element('label + j')} || CAST(j + 1 AS VARCHAR) AS atom_name,
         CAST(embedding[3 * j + 1] AS DOUBLE) * 100 AS x, CAST(embedding[3 * j + 2] AS DOUBLE) * 100 AS y,
         CAST(embedding[3 * j + 3] AS DOUBLE) * 100 AS z,
         {_element('label + j')} || CASE WHEN j % 2 = 1 THEN '.3' ELSE '' END AS sybyl_type,
         CAST(j // 7 + 1 AS INTEGER) AS resnum, 'RES' || CAST(j // 7 + 1 AS VARCHAR) AS resname,
         CAST(embedding[64] AS DOUBLE) AS charge, {_element('label + j')} AS element,
         {_radius(_element('label + j'))} AS radius, j
  FROM embeddings, range(0, 21) t(j))
"""

_rows = (line.split("\t") for line in ELEMENTS_TSV.splitlines())
_ELEMENTS = "el(symbol, mass) AS (VALUES " + ", ".join(
    f"('{symbol.lower()}', CAST({mass} AS DOUBLE))" for _, symbol, _, mass in _rows
) + ")"

_SITE = f"""
site AS (SELECT *, CAST(row_number() OVER (ORDER BY x, y, z, atom_id) - 1 AS INTEGER) AS bit
         FROM points WHERE label <= 1 AND {_IN_BOX})
"""
_CONTACTS = """
touch AS (SELECT DISTINCT a.mol_id, s.bit FROM atoms a, site s
          WHERE sqrt(pow(a.x - s.x, 2) + pow(a.y - s.y, 2) + pow(a.z - s.z, 2)) < 4.5)
"""


def _pairs(space: str, where: str = "TRUE") -> str:
    """All pairs of chosen compounds, later one first."""
    sim = _sim(f"a.{space}", f"b.{space}")
    return (
        f"SELECT a.name AS a, b.name AS b, a.ord AS a_ord, b.ord AS b_ord, {sim} AS sim "
        f"FROM v a, v b WHERE a.ord > b.ord AND {where.replace('$', 'a.')} AND {where.replace('$', 'b.')}"
    )


_LABELLED = "$label_id <= 1"


def _tree(pairs: str, leaves: str, linkage: str = "weighted", prefix: str = "") -> list[str]:
    """Recursive merging. ``pairs``: tree, hi, lo, d; ``leaves``: tree, ord, name.

    Ends in ``<prefix>clade`` (tree, node, ord, name), ``<prefix>head`` (tree, node, kept, d, size, lft, rgt).
    """
    p = prefix
    if linkage == "weighted":
        mixed, carried = "sum(d) / count(*)", "CAST(1 AS DOUBLE)"
        state = f"""
{p}st AS (
  SELECT tree, 0 AS step, hi, lo, d FROM {pairs}
  UNION ALL
  SELECT tree, step + 1, greatest(h, l), least(h, l), {mixed} FROM (
    SELECT tree, step, d, CASE WHEN hi = bh THEN bl ELSE hi END AS h, CASE WHEN lo = bh THEN bl ELSE lo END AS l
    FROM (SELECT *, first_value(hi) OVER w AS bh, first_value(lo) OVER w AS bl FROM {p}st
          WINDOW w AS (PARTITION BY tree ORDER BY d, hi DESC, lo DESC))) WHERE h <> l
  GROUP BY tree, step, greatest(h, l), least(h, l))"""
    else:
        # the sizes of both clusters travel with their pair
        state = f"""
{p}st AS (
  SELECT tree, 0 AS step, hi, lo, d, CAST(1 AS DOUBLE) AS nh, CAST(1 AS DOUBLE) AS nl FROM {pairs}
  UNION ALL
  SELECT tree, step + 1, greatest(h, l), least(h, l),
         CASE WHEN count(*) = 1 THEN max(d)
              ELSE (max(CASE WHEN up THEN wt * d END) + max(CASE WHEN NOT up THEN wt * d END)) / sum(wt) END,
         CASE WHEN count(*) = 1 THEN max(sh) WHEN greatest(h, l) = max(bl) THEN sum(wt) ELSE max(other) END,
         CASE WHEN count(*) = 1 THEN max(sl) WHEN least(h, l) = max(bl) THEN sum(wt) ELSE max(other) END
  FROM (
    SELECT tree, step, d, bl, CASE WHEN hi = bh THEN bl ELSE hi END AS h,
           CASE WHEN lo = bh THEN bl ELSE lo END AS l, hi = bh OR lo = bh AS up,
           CASE WHEN hi IN (bh, bl) THEN nh ELSE nl END AS wt, CASE WHEN hi IN (bh, bl) THEN nl ELSE nh END AS other,
           nh AS sh, nl AS sl
    FROM (SELECT *, first_value(hi) OVER w AS bh, first_value(lo) OVER w AS bl FROM {p}st
          WINDOW w AS (PARTITION BY tree ORDER BY d, hi DESC, lo DESC))) WHERE h <> l
  GROUP BY tree, step, greatest(h, l), least(h, l))"""
    return [
        state,
        f"""
{p}best AS (
  SELECT tree, step, hi, lo, d FROM (
    SELECT *, row_number() OVER (PARTITION BY tree, step ORDER BY d, hi DESC, lo DESC) AS rn FROM {p}st) WHERE rn = 1)""",
        f"""
{p}mem AS (
  SELECT tree, -1 AS step, ord, name, ord AS slot FROM {leaves}
  UNION ALL
  SELECT m.tree, m.step + 1, m.ord, m.name, CASE WHEN m.slot = g.hi THEN g.lo ELSE m.slot END
  FROM {p}mem m JOIN {p}best g ON g.tree = m.tree AND g.step = m.step + 1)""",
        f"""
{p}clade AS (
  SELECT g.tree, g.step, g.hi AS node, g.lo AS kept, g.d, m.ord, m.name
  FROM {p}best g JOIN {p}mem m ON m.tree = g.tree AND m.step = g.step AND m.slot = g.lo)""",
    ]


# children: the last earlier merge whose cluster sits in the slot, else the leaf itself
_MERGES = """
SELECT g.hi AS node,
       coalesce((SELECT arg_max(e.hi, e.step) FROM best e WHERE e.step < g.step AND e.lo = g.hi), -1 - g.hi) AS "left",
       coalesce((SELECT arg_max(e.hi, e.step) FROM best e WHERE e.step < g.step AND e.lo = g.lo), -1 - g.lo) AS "right",
       (SELECT count(*) FROM clade k WHERE k.step = g.step) AS size,
       round(g.d / 2, 6) AS height
FROM best g
"""


def _one_tree(space: str, linkage: str = "weighted", prefix: str = "", dist: str | None = None) -> list[str]:
    source = dist or f"SELECT 0 AS tree, a_ord AS hi, b_ord AS lo, 1 - sim AS d FROM ({_pairs(space, _LABELLED)})"
    return [
        f"{prefix}tp AS ({source})",
        f"{prefix}tl AS (SELECT 0 AS tree, ord, name FROM v WHERE label_id <= 1)",
        *_tree(f"{prefix}tp", f"{prefix}tl", linkage, prefix),
    ]


_YES = "avg(CASE WHEN lower(substr(name, 1, 3)) = 'yes' THEN 1.0 ELSE 0.0 END)"


def _means(space: str, members: str, base: str = "v", extra: str = "") -> str:
    """Mean similarity of base compounds to subsets (subset, name)."""
    return f"""
SELECT m.subset, b.name, round(sum({_sim(f't.{space}', f'b.{space}')}) / count(*), 9) AS avg_sim
FROM {members} m JOIN v t ON t.name = m.name CROSS JOIN v b
WHERE b.label_id > 1 GROUP BY m.subset, b.name"""


def _cut(percent: float) -> str:
    return f"floor(CAST({percent / 100.0!r} AS DOUBLE) * CAST(n AS DOUBLE))"


# --- pattern pieces

_BITS = """
lab AS (SELECT * FROM v WHERE label IS NOT NULL),
lbit AS (SELECT l.label, l.ord, l.chem, CAST(b AS INTEGER) AS bit FROM lab l, range(0, 32) t(b) WHERE (l.con >> b) & 1 = 1),
size AS (SELECT label, count(*) AS members FROM lab GROUP BY label)
"""


def _pattern(kind: int) -> str:
    sim = _sim("m.chem", "p.chem")
    added = {1: "1.0", 2: f"1 - coalesce(avg({sim}), 0)", 3: f"1 - coalesce(max({sim}), 0)"}[kind]
    return f"""
pattern AS (
  SELECT label, bit, CAST(sum(added) AS DOUBLE) / max(members) AS weight FROM (
    SELECT m.label, m.ord, m.bit, {added} AS added
    FROM lbit m LEFT JOIN lbit p ON p.label = m.label AND p.bit = m.bit AND p.ord < m.ord
    GROUP BY m.label, m.ord, m.bit) JOIN size USING (label)
  GROUP BY label, bit)
"""


_PAT = """
pat AS (SELECT CAST(b AS INTEGER) AS bit,
               coalesce(max(CASE WHEN label = 'yes' THEN weight END), 0.0) AS yes,
               coalesce(max(CASE WHEN label = 'not' THEN weight END), 0.0) AS no
        FROM range(0, 32) t(b) LEFT JOIN pattern p ON p.bit = b GROUP BY b)
"""
_SCORES = """
scores AS (
  SELECT name, sum(yes * ((con >> bit) & 1)) - CASE WHEN sum(no * ((con >> bit) & 1)) = 0 THEN 0.1
         ELSE sum(no * ((con >> bit) & 1)) END AS score
  FROM v, pat WHERE label_id > 1 GROUP BY name)
"""
_DIFF = """
mean AS (SELECT avg(yes) AS my, avg(no) AS mn FROM pat),
raw AS (
  SELECT bit, yes, no, CASE
      WHEN no > 0 THEN CASE WHEN yes > no THEN yes / no WHEN yes > 0 THEN -(no / yes) ELSE -(no / mn) END
      WHEN my > 0 THEN yes / my ELSE 0.0 END AS d
  FROM pat, mean),
diff AS (SELECT bit, yes, no, CASE WHEN no > 0 AND abs(d) < 1.05 THEN 0.0 WHEN no <= 0 AND d < 1.05 THEN 0.0 ELSE d END AS diff FROM raw)
"""

# --- sweep


def _sweep_axis(axis: str, other: tuple, order: str, gap: float, reference: bool) -> str:
    """Score changes of one axis. ``other``: (sub, walked axis, direction)."""
    subs = []
    for sub, (inner, forward) in enumerate(other):
        at = "-15 + 0.5 * l" if forward else "15 - 0.5 * l"
        subs.append(
            f"SELECT {sub} AS sub, o AS outer_no, CAST(l AS INTEGER) AS line, p.* FROM ranked_{axis} p, range(0, 60) a(o), range(0, 60) b(l) "
            f"WHERE (-15 + 0.5 * o) BETWEEN p.{axis} - radius AND p.{axis} + radius "
            f"AND ({at}) BETWEEN p.{inner} - radius AND p.{inner} + radius"
        )
    part = "sub, outer_no" if reference else "sub, outer_no, line"
    usable = "prev_rank > 0" if reference and axis in ("x", "z") else "prev_rank >= 0"
    stay = "coalesce(lead(line) OVER (PARTITION BY sub, outer_no ORDER BY line), 60) - line" if reference else "1"
    unmet = (
        f"""
  UNION ALL
  SELECT (SELECT atom_id FROM ranked_{axis} ORDER BY rk DESC LIMIT 1), -12 * (14400 - coalesce((SELECT sum(60 - first_line) FROM (
    SELECT min(line) AS first_line FROM hit_{axis} GROUP BY sub, outer_no)), 0))"""
        if reference
        else ""
    )
    return f"""
ranked_{axis} AS (SELECT *, row_number() OVER (ORDER BY {order}, atom_id) - 1 AS rk FROM box),
hit_{axis} AS ({' UNION ALL '.join(subs)}),
met_{axis} AS (
  SELECT *, lag(rk) OVER w AS prev_rank, lag(atom_id) OVER w AS pid,
         sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2))
           - radius - lag(radius) OVER w AS gap
  FROM hit_{axis} WINDOW w AS (PARTITION BY {part} ORDER BY line, rk)),
change_{axis} AS (
  SELECT atom_id, -12 AS change FROM met_{axis} WHERE prev_rank IS NULL OR NOT ({usable})
  UNION ALL SELECT atom_id, 1 FROM met_{axis} WHERE {usable} AND gap >= {gap}
  UNION ALL SELECT pid, 1 FROM met_{axis} WHERE {usable} AND gap >= {gap}
  UNION ALL SELECT last_id, -12 * stay FROM (
    SELECT last_id, {stay} AS stay FROM (
      SELECT sub, outer_no, line, arg_max(atom_id, rk) AS last_id FROM hit_{axis} GROUP BY ALL)){unmet})
"""


def _sweep(reference: bool) -> str:
    axes = {
        "x": ((("y", True), ("y", False), ("z", True), ("z", False)), "z", 3.5),
        "y": ((("z", True), ("z", False), ("x", True), ("x", False)), "x, z", 4.0),
        "z": ((("x", True), ("x", False), ("y", True), ("y", False)), "y, x, z", 3.5),
    }
    parts = [_POINTS, f"box AS (SELECT * FROM points WHERE {_IN_BOX})"]
    parts += [_sweep_axis(a, other, order, gap, reference) for a, (other, order, gap) in axes.items()]
    parts.append(
        "scored AS (SELECT box.*, CAST(coalesce(t.s, 0) AS BIGINT) AS score FROM box LEFT JOIN (SELECT atom_id, sum(change) AS s FROM ("
        "SELECT * FROM change_x UNION ALL SELECT * FROM change_y UNION ALL SELECT * FROM change_z) GROUP BY atom_id) t USING (atom_id))"
    )
    return _with(*parts)


# --- docking logs

_LOGS = r"""
src AS (
  SELECT 'lig_' || CAST(event_id AS VARCHAR) AS ligand, event_type, value FROM events),
cand AS (
  SELECT ligand, event_type, CAST(i AS INTEGER) AS mode, round(0.25 * (i - 1) - value, 2) AS energy
  FROM src, range(1, 5) t(i)),
modes AS (
  SELECT ligand, mode, energy, CAST(mode - 0.5 AS DOUBLE) AS rmsd_lb, CAST(mode + 0.25 AS DOUBLE) AS rmsd_ub FROM cand
  WHERE event_type <> 'signup' AND mode <= CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 2 ELSE 4 END),
status AS (
  SELECT ligand, event_type NOT IN ('signup', 'error', 'view') AS finished, event_type NOT IN ('signup', 'error') AS ok FROM src),
summary AS (
  SELECT s.ligand AS "Name", max(CASE WHEN mode = 1 THEN energy END) AS "1_Energy",
         max(CASE WHEN mode = 2 THEN energy END) AS "2_Energy", max(CASE WHEN mode = 2 THEN rmsd_lb END) AS "2_RMSDLB",
         max(CASE WHEN mode = 2 THEN rmsd_ub END) AS "2_RMSDRB", max(CASE WHEN mode = 3 THEN energy END) AS "3_Energy",
         max(CASE WHEN mode = 3 THEN rmsd_lb END) AS "3_RMSDLB", max(CASE WHEN mode = 3 THEN rmsd_ub END) AS "3_RMSDRB"
  FROM src s LEFT JOIN modes m ON m.ligand = s.ligand GROUP BY s.ligand)
"""

# --- circular fingerprints


def _mix(a: str, b: str) -> str:
    t = f"(({a}) * 1000003 + ({b})) % 2147483647"
    return f"(((({t}) * ({t})) % 2147483647 * 48271 + ({t}) * 16807 + 1) % 2147483647)"


_CIRCULAR = f"""
atom AS (
  SELECT l_orderkey AS mol, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linestatus, l_returnflag) AS BIGINT) AS serial,
         l_linestatus AS element, l_returnflag AS flag
  FROM lineitem),
bond AS (
  SELECT a.mol, a.serial AS a, b.serial AS b, CASE a.flag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS code
  FROM atom a JOIN atom b ON b.mol = a.mol AND b.serial = a.serial + 1),
edge AS (
  SELECT mol, a AS serial, b AS other, CAST(code AS BIGINT) AS code, {_mix('CAST(a AS BIGINT)', 'CAST(b AS BIGINT)')} AS id FROM bond
  UNION ALL SELECT mol, b, a, CAST(code AS BIGINT), {_mix('a', 'b')} FROM bond),
degree AS (SELECT mol, serial, count(*) AS degree FROM edge GROUP BY ALL),
r0 AS (
  SELECT a.mol, a.serial, {_mix(_mix('CAST(ascii(element) AS BIGINT) * 256', 'coalesce(degree, 0)'), '0')} AS hash, CAST([] AS BIGINT[]) AS cover
  FROM atom a LEFT JOIN degree d ON d.mol = a.mol AND d.serial = a.serial),
s1 AS (
  SELECT e.mol, e.serial, CAST(sum({_mix('e.code', 'n.hash')}) AS BIGINT) % 2147483647 AS total, flatten(list(list_concat([e.id], n.cover))) AS reach
  FROM edge e JOIN r0 n ON n.mol = e.mol AND n.serial = e.other GROUP BY ALL),
r1 AS (
  SELECT r.mol, r.serial, {_mix('r.hash + 1', 's.total')} AS hash, list_sort(list_distinct(list_concat(r.cover, s.reach))) AS cover
  FROM r0 r JOIN s1 s ON s.mol = r.mol AND s.serial = r.serial),
s2 AS (
  SELECT e.mol, e.serial, CAST(sum({_mix('e.code', 'n.hash')}) AS BIGINT) % 2147483647 AS total, flatten(list(list_concat([e.id], n.cover))) AS reach
  FROM edge e JOIN r1 n ON n.mol = e.mol AND n.serial = e.other GROUP BY ALL),
r2 AS (
  SELECT r.mol, r.serial, {_mix('r.hash + 2', 's.total')} AS hash, list_sort(list_distinct(list_concat(r.cover, s.reach))) AS cover
  FROM r1 r JOIN s2 s ON s.mol = r.mol AND s.serial = r.serial),
grown AS (SELECT mol, hash, cover, 1 AS round FROM r1 UNION ALL SELECT mol, hash, cover, 2 FROM r2),
kept AS (
  SELECT mol, hash FROM (SELECT *, row_number() OVER (PARTITION BY mol, cover ORDER BY round, hash) AS rn FROM grown) WHERE rn = 1)
"""

_RANKED_CHEM = f"""
ranked AS (
  SELECT b.name, t.name AS other, {_sim('b.chem', 't.chem')} AS sim,
         CAST(row_number() OVER (PARTITION BY b.name ORDER BY {_sim('b.chem', 't.chem')} DESC, t.name) AS INTEGER) AS rank
  FROM v b, v t WHERE b.label_id > 1 AND t.label_id <= 1)
"""


def _similar(space: str, name: str) -> str:
    sim = _sim(f"b.{space}", f"t.{space}")
    return f"""
{name}_r AS (
  SELECT b.name, t.name AS other, {sim} AS sim, row_number() OVER (PARTITION BY b.name ORDER BY {sim} DESC, t.name) AS rk
  FROM v b, v t WHERE b.label_id > 1 AND t.label_id <= 1),
{name} AS (
  SELECT name, string_agg(substr(other, 5) || ':' || CASE WHEN other LIKE 'yes%' THEN 'inhibitor' ELSE 'notinhibitor' END
         || ':' || coalesce(p_name, '') || ':' || CAST(CAST(trunc(sim * 100) AS INTEGER) AS VARCHAR), ';' ORDER BY rk) AS txt
  FROM {name}_r LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = substr(other, 5) WHERE rk <= 3 GROUP BY name)
"""


def _alone(space: str, members: str, key: str, base: str, count: str, percent: float) -> str:
    """Union of every member's own best: as many as the percentage over the clade's size, 10 at least."""
    sim = _sim(f"t.{space}", f"b.{space}")
    return f"""
SELECT DISTINCT {key}, name FROM (
  SELECT {', '.join('m.' + k for k in key.split(', '))}, b.name, row_number() OVER (PARTITION BY {', '.join('m.' + k for k in key.split(', '))}, m.name ORDER BY {sim} DESC, b.name) AS rk,
         greatest(10, CAST(floor(CAST({percent / 100.0!r} AS DOUBLE) * n / m.size) AS BIGINT)) AS amount
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM {members}) m JOIN v t ON t.name = m.name {base} {count}) WHERE rk <= amount"""


def _screen(isolated: bool = False) -> list[str]:
    """Two-level screen; ends in ``screened`` (subset, name, energy, rank)."""
    inner_pairs = (
        "itp AS (SELECT a.tree, greatest(a.ord, b.ord) AS hi, least(a.ord, b.ord) AS lo, 1 - "
        f"({_sim('va.chem', 'vb.chem')}) AS d FROM itl a JOIN itl b ON a.tree = b.tree AND a.ord > b.ord "
        "JOIN v va ON va.ord = a.ord JOIN v vb ON vb.ord = b.ord)"
    )
    return [
        *_one_tree("con", prefix="o"),
        f"oyes AS (SELECT node FROM oclade GROUP BY node HAVING {_YES} >= 0.7)",
        "ochosen AS (SELECT node AS subset, ord, name FROM oclade WHERE node IN (SELECT node FROM oyes))",
        "nb AS (SELECT count(*) AS n FROM v WHERE label_id > 1)",
        f"omean AS ({_means('con', 'ochosen')})",
        "cand AS (SELECT subset AS scope, name FROM "
        + (
            f"({_alone('con', 'ochosen', 'subset', 'JOIN v b ON b.label_id > 1', ', nb', 60)}))"
            if isolated
            else f"(SELECT *, row_number() OVER (PARTITION BY subset ORDER BY avg_sim DESC, name) AS rk FROM omean), nb WHERE rk <= {_cut(60)})"
        ),
        "itl AS (SELECT subset AS tree, ord, name FROM ochosen)",
        inner_pairs,
        *_tree("itp", "itl", prefix="i"),
        f"iyes AS (SELECT tree, node FROM iclade GROUP BY tree, node HAVING {_YES} >= 0.8)",
        "ichosen AS (SELECT tree AS scope, node AS subset, name FROM iclade JOIN iyes USING (tree, node))",
        f"""imean AS (
  SELECT m.scope, m.subset, b.name, round(sum({_sim('t.chem', 'b.chem')}) / count(*), 9) AS avg_sim
  FROM ichosen m JOIN v t ON t.name = m.name JOIN cand c ON c.scope = m.scope JOIN v b ON b.name = c.name
  GROUP BY m.scope, m.subset, b.name)""",
        "inum AS (SELECT scope, count(*) AS n FROM cand GROUP BY scope)",
        "iwon AS (SELECT DISTINCT scope, name FROM "
        + (
            f"({_alone('chem', 'ichosen', 'scope, subset', 'JOIN cand c ON c.scope = m.scope JOIN v b ON b.name = c.name', 'JOIN inum i ON i.scope = m.scope', 75)}))"
            if isolated
            else "(SELECT *, row_number() OVER (PARTITION BY scope, subset ORDER BY avg_sim DESC, name) AS rk "
            f"FROM imean JOIN inum USING (scope)) WHERE rk <= {_cut(75)})"
        ),
        "screened AS (SELECT scope AS subset, name, energy, CAST(rk AS INTEGER) AS rank FROM (SELECT i.scope, i.name, v.energy, "
        "row_number() OVER (PARTITION BY i.scope ORDER BY v.energy, i.name) AS rk FROM iwon i JOIN v ON v.name = i.name) WHERE rk <= 30)",
    ]


_BLEND = (
    "SELECT 0 AS tree, x.a_ord AS hi, x.b_ord AS lo, ((1 - x.sim) + (1 - y.sim) * 0.5) / 1.5 AS d FROM "
    f"({_pairs('chem', _LABELLED)}) x JOIN ({_pairs('con', _LABELLED)}) y USING (a_ord, b_ord)"
)
# chem vector of the compound, then the contact vector of the first name that contains its short id
_JOINED = """
first_box AS (SELECT c.ord, min(f.ord) AS box_ord FROM c JOIN c f ON contains(f.name, CAST(c.ord AS VARCHAR)) {where} GROUP BY c.ord),
joined AS (
  SELECT b.ord, CAST(v1.chem AS HUGEINT) | (CAST(v2.con AS HUGEINT) << 32) AS words FROM first_box b JOIN v v1 ON v1.ord = b.ord JOIN v v2 ON v2.ord = b.box_ord)
"""


def _joined_text(name: str) -> str:
    return f"""
SELECT {name} AS name, coalesce((SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM range(0, 64) t(b)
       WHERE (j.words >> CAST(b AS INTEGER)) & 1 = 1), '') AS bits FROM joined j JOIN c USING (ord)"""


SQL: dict[str, str] = {
    "train_base_topk": _with(_COMPOUNDS, _RANKED_CHEM)
    + "SELECT name, other, rank, round(sim, 6) AS sim, CAST(trunc(sim * 100) AS INTEGER) AS percent FROM ranked WHERE rank <= 3",
    "train_base_matrix": _with(_COMPOUNDS)
    + f"SELECT * FROM (SELECT t.name AS left_name, b.name AS right_name, round({_sim('t.con', 'b.con')}, 6) AS sim "
    "FROM v t, v b WHERE t.label_id <= 1 AND b.label_id > 1) WHERE sim > 0",
    "similarity_stats": _with(_COMPOUNDS, _RANKED_CHEM)
    + "SELECT name, round(max(sim), 6) AS max_sim, round(avg(sim), 6) AS avg_sim FROM ranked GROUP BY name",
    "all_pairs_distance": _with(_COMPOUNDS)
    + f"SELECT a, b, round(sim, 6) AS sim, round(1 - sim, 6) AS dist FROM ({_pairs('chem')})",
    "lower_triangle_rows": _with(_COMPOUNDS)
    + "SELECT v.ord, concat_ws(chr(9), v.name, p.cells) AS line FROM v LEFT JOIN (SELECT a_ord, "
    f"string_agg(printf('%.4f', 1 - sim), chr(9) ORDER BY b_ord) AS cells FROM ({_pairs('con')}) GROUP BY a_ord) p ON p.a_ord = v.ord",
    "blended_similarity": _with(_COMPOUNDS)
    + f"SELECT x.a, x.b, round(((1 - x.sim) + (1 - y.sim) * 0.5) / 1.5, 6) AS dist FROM ({_pairs('chem')}) x "
    f"JOIN ({_pairs('con')}) y USING (a_ord, b_ord)",
    "concat_fingerprint": _with(_COMPOUNDS, _JOINED.format(where=""))
    + _joined_text("'any_' || CAST(c.ord AS VARCHAR) || '_' || CAST(c.label_id AS VARCHAR)"),
    "concat_by_exact_id": _with(_COMPOUNDS, "joined AS (SELECT ord, CAST(chem AS HUGEINT) | (CAST(con AS HUGEINT) << 32) AS words FROM v)")
    + _joined_text("c.name"),
    "mean_similarity_top_percent": _with(
        _COMPOUNDS,
        "mem AS (SELECT CAST(label_id AS BIGINT) AS subset, name FROM v WHERE label_id <= 1)",
        f"mean AS ({_means('chem', 'mem')})",
        "nb AS (SELECT count(*) AS n FROM v WHERE label_id > 1)",
    )
    + "SELECT subset, name, round(avg_sim, 6) AS avg_sim FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY avg_sim DESC, name) AS rk "
    f"FROM mean), nb WHERE rk <= {_cut(10)}",
    "isolated_top": _with(
        _COMPOUNDS,
        "amount AS (SELECT label_id, greatest(10, CAST(floor(CAST(150 / 100.0 AS DOUBLE) * (SELECT count(*) FROM v WHERE label_id > 1) / count(*)) AS BIGINT)) AS n "
        "FROM v WHERE label_id <= 1 GROUP BY label_id)",
    )
    + f"SELECT DISTINCT subset, name FROM (SELECT CAST(t.label_id AS BIGINT) AS subset, n, b.name, row_number() OVER (PARTITION BY t.name "
    f"ORDER BY {_sim('t.chem', 'b.chem')} DESC, b.name) AS rk FROM v t JOIN amount a ON a.label_id = t.label_id, v b WHERE b.label_id > 1) WHERE rk <= n",
    "box_filter_bounds": _with(_ATOMS)
    + "SELECT mol_id, round(min(x), 6) AS minx, round(max(x), 6) AS maxx, round(min(y), 6) AS miny, round(max(y), 6) AS maxy, "
    f"round(min(z), 6) AS minz, round(max(z), 6) AS maxz FROM atoms WHERE {_IN_BOX} GROUP BY mol_id",
    "box_quality": _with(_POINTS)
    + f"SELECT count(*) AS protein_atoms, count(*) FILTER (WHERE {_IN_BOX}) AS box_atoms, "
    f"count(*) FILTER (WHERE {_IN_BOX}) < 10 AS too_few FROM points",
    "box_xyz_lines": _with(
        _POINTS,
        "whole AS (SELECT atom_id, element, round(x, 3) AS x, round(y, 3) AS y, round(z, 3) AS z FROM points)",
        f"inside AS (SELECT * FROM whole WHERE {_IN_BOX})",
    )
    + "SELECT CAST(-2 AS BIGINT) AS pos, CAST(count(*) AS VARCHAR) AS line FROM inside UNION ALL SELECT -1, 'ProteinBox' UNION ALL "
    "SELECT atom_id, concat_ws(chr(9), element, CAST(x AS VARCHAR), CAST(y AS VARCHAR), CAST(z AS VARCHAR)) FROM inside",
    "xyz_parse": _with(_ATOMS)
    + "SELECT name, CAST(j + 2 AS INTEGER) AS line_no, element, radius, 'LIG' AS resname, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms",
    "atom_geometry": _with(_ATOMS)
    + "SELECT mol_id, round(d, 6) AS distance, round(d - r1 - r2, 6) AS gap, abs(y1 - y2 / 4) <= r1 AND abs(z1 - z2 / 4) <= r1 AS crosses_x, "
    "abs(x1 - x2 / 4) <= r1 AND abs(z1 - z2 / 4) <= r1 AS crosses_y, abs(x1 - x2 / 4) <= r1 AND abs(y1 - y2 / 4) <= r1 AS crosses_z FROM ("
    "SELECT p.mol_id, p.x AS x1, p.y AS y1, p.z AS z1, p.radius AS r1, q.x AS x2, q.y AS y2, q.z AS z2, q.radius AS r2, "
    "sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2)) AS d FROM atoms p JOIN atoms q USING (mol_id) WHERE p.j = 0 AND q.j = 1)",
    "contact_join": _with(_POINTS, _ATOMS, _SITE, _CONTACTS) + "SELECT mol_id, bit FROM touch",
    "contact_fingerprint": _with(_POINTS, _ATOMS, _SITE, _CONTACTS)
    + "SELECT m.name, coalesce(string_agg(CAST(bit AS VARCHAR), ',' ORDER BY bit), '') AS bits FROM "
    "(SELECT DISTINCT mol_id, name FROM atoms) m LEFT JOIN touch t ON t.mol_id = m.mol_id GROUP BY m.name",
    "cavity_sweep_scores": _sweep(True) + "SELECT atom_id, score FROM scored",
    "cavity_sweep_clean": _sweep(False) + "SELECT atom_id, score FROM scored",
    "cavity_sweep_sites": _sweep(True)
    + "SELECT atom_id, score, CAST(row_number() OVER (ORDER BY x, y, z, atom_id) - 1 AS INTEGER) AS bit FROM (SELECT *, row_number() OVER "
    "(ORDER BY score DESC, y, x, z, atom_id) AS rk FROM scored) WHERE rk <= 20 * (SELECT count(*) FROM box) // 100",
    **{
        f"class_pattern_{name}": _with(_COMPOUNDS, _BITS, _pattern(kind))
        + "SELECT label, bit, round(weight, 6) AS weight FROM pattern"
        for name, kind in (("count", 1), ("mean", 2), ("max", 3))
    },
    "net_score": _with(_COMPOUNDS, _BITS, _pattern(3), _PAT, _SCORES)
    + 'SELECT v.name AS "Id", round(score, 6) AS "Score", energy AS "Energy" FROM scores JOIN v USING (name)',
    "bit_differences": _with(_COMPOUNDS, _BITS, _pattern(3), _PAT, _DIFF)
    + "SELECT bit, round(yes, 6) AS yes, round(no, 6) AS no, round(diff, 6) AS diff FROM diff",
    "essential_groups": _with(_COMPOUNDS, _BITS, _pattern(3), _PAT, _DIFF)
    + "SELECT 'R' || CAST(bit // 8 AS VARCHAR) AS resname, coalesce(string_agg(CASE WHEN diff <> 0 THEN 'A' || lpad(CAST(bit AS VARCHAR), 2, '0') END, ',' "
    "ORDER BY bit DESC), '') AS atoms FROM diff GROUP BY bit // 8",
    "tree_merges": _with(_COMPOUNDS, *_one_tree("con"), recursive=True) + _MERGES,
    "tree_merges_by_size": _with(_COMPOUNDS, *_one_tree("chem", "average"), recursive=True) + _MERGES,
    "clades": _with(_COMPOUNDS, *_one_tree("con"), recursive=True) + "SELECT node, name FROM clade",
    "clade_table": _with(
        _COMPOUNDS,
        *_one_tree("con"),
        f"m AS ({_MERGES})",
        """
child AS (SELECT node, "left" AS below, CAST(0 AS BIGINT) AS shift FROM m UNION ALL
          SELECT a.node, a."right", coalesce(l.size, 1) FROM m a LEFT JOIN m l ON l.node = a."left")""",
        """
way AS (SELECT node, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS before FROM m WHERE size = (SELECT max(size) FROM m) UNION ALL
        SELECT below, first + shift, before + greatest(shift - 1, 0) FROM way JOIN child USING (node))""",
        recursive=True,
    )
    + 'SELECT before + size - 2 AS place, node, "left", "right", first, size FROM m JOIN way USING (node)',
    "yes_clades": _with(_COMPOUNDS, *_one_tree("con"), recursive=True)
    + f"SELECT node, round({_YES}, 6) AS share, count(*) AS size FROM clade GROUP BY node HAVING {_YES} >= 0.7",
    "clade_candidates": _with(
        _COMPOUNDS,
        *_one_tree("chem"),
        f"yes AS (SELECT node FROM clade GROUP BY node HAVING {_YES} >= 0.75)",
        "chosen AS (SELECT node AS subset, name FROM clade WHERE node IN (SELECT node FROM yes))",
        f"mean AS ({_means('chem', 'chosen')})",
        "nb AS (SELECT count(*) AS n FROM v WHERE label_id > 1)",
        recursive=True,
    )
    + "SELECT subset, name, round(avg_sim, 6) AS avg_sim FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY avg_sim DESC, name) AS rk "
    f"FROM mean), nb WHERE rk <= {_cut(2)}",
    "blended_tree": _with(_COMPOUNDS, *_one_tree("chem", dist=_BLEND), recursive=True) + _MERGES,
    "concatenated_tree": _with(
        _COMPOUNDS,
        _JOINED.format(where="WHERE c.label_id <= 1 AND f.label_id <= 1"),
        *_one_tree(
            "chem",
            dist="SELECT 0 AS tree, a.ord AS hi, b.ord AS lo, 1 - "
            f"({_sim('a.words', 'b.words')}) AS d FROM joined a JOIN joined b ON a.ord > b.ord",
        ),
        recursive=True,
    )
    + _MERGES,
    "isolated_screen": _with(_COMPOUNDS, *_screen(isolated=True), recursive=True) + "SELECT subset, name, energy, rank FROM screened",
    "two_level_screen": _with(_COMPOUNDS, *_screen(), recursive=True) + "SELECT subset, name, energy, rank FROM screened",
    "cluster_best_by_energy": _with(_COMPOUNDS)
    + "SELECT name, energy FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY energy, name) AS rk FROM v WHERE label_id > 1) WHERE rk <= 30",
    "report_table": _with(
        _COMPOUNDS, _BITS, _pattern(3), _PAT, _SCORES, _similar("con", "scon"), _similar("chem", "schem"),
        "top AS (SELECT replace(name, 'ZINC', '') AS id, * FROM v WHERE label_id > 1 ORDER BY energy, replace(name, 'ZINC', '') LIMIT 150)",
    )
    + "SELECT t.id, t.energy, round(s.score, 6) AS score, CASE WHEN s.score < 1.5 THEN 'red' WHEN s.score >= 1.7 THEN 'green' ELSE '' END AS band, "
    f"CASE WHEN length(t.id) > 4 THEN replace('{COMPOUND_IMAGE}', '%s', t.id) ELSE replace('{LIGAND_IMAGE}', '%s', t.id) END AS image, "
    'a.txt AS "similarContacts", b.txt AS "similarChem" FROM top t JOIN scores s ON s.name = t.name JOIN scon a ON a.name = t.name JOIN schem b ON b.name = t.name',
    "screen_report": _with(
        _COMPOUNDS, _BITS, _pattern(3), _PAT, _SCORES, _similar("con", "scon"), _similar("chem", "schem"), *_screen(), recursive=True
    )
    + "SELECT replace(t.name, 'ZINC', '') AS id, t.energy, round(s.score, 6) AS score, "
    'a.txt AS "similarContacts", b.txt AS "similarChem" FROM (SELECT DISTINCT name, energy FROM screened) t '
    "JOIN scores s ON s.name = t.name JOIN scon a ON a.name = t.name JOIN schem b ON b.name = t.name",
    "molecule_mass": _with(_ELEMENTS)
    + "SELECT l_orderkey AS mol_id, round(sum(coalesce(a.mass, 0) + coalesce(b.mass, 0)), 6) AS mass FROM lineitem "
    "LEFT JOIN el a ON a.symbol = lower(l_returnflag) LEFT JOIN el b ON b.symbol = lower(l_linestatus) GROUP BY 1",
    "residue_mass": _with(_ELEMENTS, _ATOMS)
    + "SELECT mol_id, resnum, resname, round(sum(coalesce(mass, 0)), 6) AS mass FROM atoms LEFT JOIN el ON symbol = lower(element) GROUP BY ALL",
    "unknown_elements": _with(
        _ELEMENTS,
        "e AS (SELECT lower(l_returnflag) AS symbol FROM lineitem UNION ALL SELECT lower(l_linestatus) FROM lineitem)",
    )
    + "SELECT symbol, count(*) AS atoms FROM e WHERE symbol NOT IN (SELECT symbol FROM el) GROUP BY symbol",
    "docking_log_parse": _with(_LOGS)
    + 'SELECT summary.*, finished, ok FROM summary JOIN status ON status.ligand = summary."Name"',
    "docking_modes": _with(_LOGS) + "SELECT ligand, mode, energy, rmsd_lb, rmsd_ub FROM modes",
    "docking_results_table": _with(_LOGS) + 'SELECT "Name" AS ligand, "1_Energy" AS energy FROM summary',
    "docking_stream": _with(_LOGS) + "SELECT * FROM summary",
    "docking_collection": "SELECT 'mol_' || CAST(vec_id AS VARCHAR) AS ligand, CAST(22 AS INTEGER) AS lines FROM embeddings",
    "first_pose": "SELECT user_id AS ligand, min(event_id) AS model_no, arg_min(value, event_id) AS value FROM events GROUP BY user_id",
    "last_duplicate": "SELECT user_id AS name, max(event_id) AS ord, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "mol2_roundtrip": _with(_ATOMS)
    + "SELECT name, serial, atom_name, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, sybyl_type, resnum, resname, charge, element, radius FROM atoms",
    "mol2_bonds": "SELECT 'mol_' || CAST(vec_id AS VARCHAR) AS name, CAST(i AS INTEGER) AS bond_id, CAST(i AS INTEGER) AS a, CAST(i + 1 AS INTEGER) AS b, "
    "CASE WHEN i % 2 = 0 THEN '2' ELSE '1' END AS btype FROM embeddings, range(1, 21) t(i)",
    "skip_and_first": "SELECT 'mol_' || CAST(vec_id AS VARCHAR) AS name FROM embeddings ORDER BY vec_id LIMIT 20 OFFSET 10",
    "pdbqt_roundtrip": _with(_ELEMENTS, _ATOMS)
    + "SELECT name AS ligand, round(sum(coalesce(mass, 0)), 6) AS mass FROM atoms LEFT JOIN el ON symbol = lower(CASE WHEN regexp_matches(substr(atom_name, 1, 2), "
    "'^[A-Z][A-Z]$') THEN substr(element, 1, 1) ELSE regexp_extract(rpad(substr(atom_name, 1, 2), 2, ' '), '[A-Za-z][A-Za-z0-9]*') END) "
    "WHERE j % 5 <> 4 GROUP BY name",
    "rejected_atoms": "SELECT 'mol_' || CAST(vec_id AS VARCHAR) AS name, CAST(i * 7 AS INTEGER) AS line_no FROM embeddings, range(1, 4) t(i)",
    "repeated_elements": "SELECT lower(l_returnflag) AS symbol, count(*) AS entries FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "numbered_models": "SELECT n AS number, 'MODEL ' || CAST(n AS VARCHAR) AS first, 'REMARK  Name = ' || name AS second, CAST(24 AS INTEGER) AS lines FROM "
    "(SELECT 'mol_' || CAST(vec_id AS VARCHAR) AS name, row_number() OVER (ORDER BY 'mol_' || CAST(vec_id AS VARCHAR)) AS n FROM embeddings)",
    "training_names": "SELECT label || '_' || CAST(p_partkey AS VARCHAR) || '_' || regexp_replace(p_name, '[^A-Za-z0-9_|-]', '', 'g') AS name, label FROM "
    "(SELECT *, CASE WHEN p_type = 'ECONOMY' THEN 'yes' ELSE 'not' END AS label FROM part)",
    "long_names": _with(_COMPOUNDS)
    + "SELECT name, p_name AS long_name FROM v LEFT JOIN part ON CAST(p_partkey AS VARCHAR) = substr(name, 5)",
    "selected_vectors": _with(_COMPOUNDS, _POINTS)
    + "SELECT name, energy AS pos, coalesce((SELECT string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) FROM range(0, 32) t(b) WHERE (v.chem >> b) & 1 = 1), '') AS bits "
    f"FROM v WHERE label_id <= 1 AND ord IN (SELECT atom_id FROM points WHERE {_IN_BOX})",
    "path_and_name_parts": r"""
SELECT page_id, regexp_extract(url, '^((?:.*/)?)([^/]*?)(?:\.([^./]*))?$', 1) AS directory,
       regexp_extract(url, '^((?:.*/)?)([^/]*?)(?:\.([^./]*))?$', 2) AS stem,
       regexp_extract(url, '^((?:.*/)?)([^/]*?)(?:\.([^./]*))?$', 3) AS extension,
       array_to_string(list_filter(regexp_split_to_array(url, '[/?&=.]'), lambda s: s <> ''), '|') AS tokens,
       regexp_extract(substr(url, 8), '[A-Za-z][A-Za-z0-9'']*') AS identifier,
       coalesce(TRY_CAST(replace(regexp_extract(url, '^[^0-9-]*(-?[0-9]+[.,]?[0-9]*)', 1), ',', '.') AS DOUBLE), 0) AS number,
       coalesce(TRY_CAST(regexp_extract(url, '^[^0-9-]*(-?[0-9]+)', 1) AS INTEGER), 0) AS whole,
       lower(url) AS lowered FROM pages""",
    "name_parts": r"""
SELECT name, lower(substr(name, 1, 3)) AS label, substr(name, 5) AS ext_id,
       CASE WHEN lower(substr(name, 1, 3)) = 'yes' THEN 'inhibitor' ELSE 'notinhibitor' END AS kind,
       split_part(substr(name, 5), '_', 1) AS short, regexp_replace(name, '[^A-Za-z0-9_|-]', '', 'g') AS cleaned,
       CAST(p_partkey AS VARCHAR) AS base, p_retailprice AS price, regexp_matches(substr(p_name, 1, 1), '[A-Za-z]') AS letter, TRUE AS digit
FROM (SELECT *, CASE WHEN p_size > 25 THEN 'YES_' ELSE 'not_' END || CAST(p_partkey AS VARCHAR) || '_' || p_name AS name FROM part)""",
    "circular_fingerprint": _with(_CIRCULAR)
    + "SELECT DISTINCT mol AS mol_id, CAST(hash % 1024 AS INTEGER) AS bit FROM (SELECT mol, hash FROM r0 UNION ALL SELECT mol, hash FROM kept)",
}

SQL["first_log_stream"] = (
    _with(
        _LOGS,
        "ends AS (SELECT user_id, min(event_id) AS first, max(event_id) AS last, arg_min(event_type, event_id) AS kind FROM events GROUP BY user_id)",
        "picked AS (SELECT 'lig_' || user_id AS who, 'lig_' || CASE WHEN kind <> 'signup' THEN first ELSE last END AS log FROM ends)",
    )
    + """SELECT who AS "Name", summary.* EXCLUDE ("Name") FROM picked JOIN summary ON summary."Name" = log"""
)
SQL["first_pose_stream"] = _with(_ATOMS) + (
    "SELECT name AS ligand, CAST(22 AS INTEGER) AS lines, 'ATOM  ' || lpad('1', 5, ' ') || ' ' || rpad(atom_name, 4, ' ') || ' UNK A  0     ' || "
    "printf('%8.3f%8.3f%8.3f', x, y, z) || '  0.00  0.00    +0.000 ' || rpad(substr(atom_name, 1, 2), 2, ' ') AS second FROM atoms WHERE j = 0"
)
SQL["xyz_files"] = _with(_ATOMS) + (
    "SELECT name, CAST(j + 2 AS INTEGER) AS line_no, element, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms "
    "WHERE mol_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)"
)
SQL["score_file"] = SQL["net_score"]
SQL["distance_matrix_file"] = (
    _with(_COMPOUNDS)
    + "SELECT CAST(count(*) AS VARCHAR) AS line FROM v WHERE label_id <= 1 UNION ALL "
    "SELECT concat_ws(chr(9), v.name, p.cells) FROM v LEFT JOIN (SELECT a_ord, "
    f"string_agg(printf('%.4f', 1 - sim), chr(9) ORDER BY b_ord) AS cells FROM ({_pairs('con', _LABELLED)}) GROUP BY a_ord) p ON p.a_ord = v.ord WHERE label_id <= 1"
)

SQL["committed_matrix"] = SQL["distance_matrix_file"]
SQL["committed_models"] = SQL["docking_collection"]
SQL["nearest_site"] = _with(_POINTS, _ATOMS, _SITE) + (
    "SELECT mol_id, arg_min(bit, (d, bit)) AS bit, round(min(d), 6) AS distance FROM (SELECT a.mol_id, s.bit, "
    "sqrt(pow(a.x - s.x, 2) + pow(a.y - s.y, 2) + pow(a.z - s.z, 2)) AS d FROM atoms a, site s) GROUP BY mol_id"
)
SQL["box_atoms_stored"] = _with(_ATOMS) + f"SELECT mol_id, serial, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM atoms WHERE {_IN_BOX}"
SQL["run_counts"] = _with(_POINTS) + (
    f"SELECT count(*) AS protein_atoms, count(*) FILTER (WHERE {_IN_BOX}) AS box_atoms, count(*) FILTER (WHERE {_IN_BOX}) < 10 AS too_few, "
    f"20 * count(*) FILTER (WHERE {_IN_BOX}) // 100 AS site_atoms, (SELECT count(*) FROM embeddings) AS molecules FROM points"
)

# fingerprints of orders, and how many bits two of them share
_ORDER_BITS = f"""
obit AS MATERIALIZED ({SQL["circular_fingerprint"]}),
prints AS MATERIALIZED (SELECT mol_id, list(bit ORDER BY bit) AS bits, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS mine
                        FROM obit JOIN orders ON o_orderkey = mol_id GROUP BY ALL)
"""


def _shared(left: str, right: str, where: str = "TRUE") -> str:
    """Pairs that share a bit: l, r, shared, sim."""
    return f"""
SELECT l, r, count(*) AS shared, CAST(count(*) AS DOUBLE) / (max(ln) + max(rn) - count(*)) AS sim FROM
  (SELECT ord AS l, len(bits) AS ln, unnest(bits) AS bit FROM {left}) JOIN (SELECT ord AS r, len(bits) AS rn, unnest(bits) AS bit FROM {right}) USING (bit)
WHERE {where} GROUP BY l, r"""


SQL["sparse_similarity"] = (
    _with(
        _ORDER_BITS,
        "urgent AS (SELECT min(mol_id) AS ord, bits FROM prints WHERE mine GROUP BY bits)",
        "others AS (SELECT min(mol_id) AS ord, bits FROM prints WHERE NOT mine GROUP BY bits)",
    )
    + "SELECT l AS ord, count(*) AS pairs, CAST(sum(shared) AS BIGINT) AS shared, round(max(sim), 6) AS max_sim, round(sum(sim), 4) AS sum_sim "
    f"FROM ({_shared('urgent', 'others')}) GROUP BY l"
)
SQL["similar_above_threshold"] = (
    _with(_ORDER_BITS, "classes AS (SELECT min(mol_id) AS ord, bits FROM prints GROUP BY bits)")
    + f"SELECT l AS a, r AS b, round(sim, 6) AS sim FROM ({_shared('classes', 'classes', 'l > r')}) WHERE sim >= 0.6"
)

# the same numbers by another way
SQL["train_base_topk_indexed"] = SQL["train_base_topk"]
SQL["mass_file"] = f'SELECT ligand AS "Ligand", mass AS "Mass" FROM ({SQL["pdbqt_roundtrip"]})'
SQL |= {f"{name}_rounds": SQL[name] for name in ("tree_merges", "tree_merges_by_size", "clades", "yes_clades", "clade_table", "concatenated_tree", "blended_tree")}
