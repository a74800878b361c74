"""Element and radius expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from molweave.constants import DEFAULT_RADIUS_ELEMENT, VDW_RADII
from molweave.functions.text import first_identifier, is_upper_letter


def element_of_type(sybyl_type: Column) -> Column:
    """``C.ar`` -> ``C``."""
    return F.substring_index(sybyl_type, ".", 1)


def vdw_radius(element: Column) -> Column:
    radius = None
    for symbol, value in VDW_RADII.items():
        hit = element == symbol
        radius = F.when(hit, value) if radius is None else radius.when(hit, value)
    return radius.otherwise(VDW_RADII[DEFAULT_RADIUS_ELEMENT])


def element_of_pdbqt(line: Column) -> Column:
    """Element of a PDBQT atom line, from the type (chars 78-79) and atom name (chars 13-14)."""
    kind = first_identifier(F.substring(line, 78, 2))
    atom = first_identifier(F.substring(line, 13, 2))
    typed = (F.length(kind) == 2) & is_upper_letter(F.substring(kind, 2, 1))
    return F.when(typed, F.substring(atom, 1, 1)).otherwise(atom)
