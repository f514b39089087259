"""Terrain letters of grid maps, passability policies and text escapes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter -> terrain class.
TERRAIN = {".": "ground", "G": "ground", "T": "tree", "S": "swamp", "W": "water", "@": "out_of_bounds", "O": "out_of_bounds"}
POLICIES = ("GroundOnly", "GroundAndSwamp", "GroundSwampWater", "AnyTerrainLetter")


def terrain_class(ch: Column) -> Column:
    out = F.when(F.lit(False), "")
    for letter, name in TERRAIN.items():
        out = out.when(ch == letter, name)
    return out.when(ch.rlike("^[A-Z]$"), "weighted").otherwise("unknown")


def is_passable(ch: Column, policy: str) -> Column:
    """Trees, out-of-bounds and unknown letters never pass; the policies admit ever more."""
    kinds = {"GroundOnly": ["ground"], "GroundAndSwamp": ["ground", "swamp"], "GroundSwampWater": ["ground", "swamp", "water"], "AnyTerrainLetter": ["ground", "swamp", "water", "weighted"]}[policy]
    return terrain_class(ch).isin(kinds)


def xml_escape(text: Column) -> Column:
    for raw, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(raw), F.lit(f"&{name};"))
    return text
