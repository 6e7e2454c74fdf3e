"""Column functions over item ids, clip references and labels.

All are plain Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the published data format) -------------------
# Fabrication code -> type name, as published in the dataset statistics table.
FABRICATION_TYPES = {
    "TOVN_TOVM": "Misleading Substitution",
    "TNVO_TMVO": "Groundless Fabrication",
    "TOVO_TMVO": "Fact Distortion",
    "TOVO_TOVM": "Selective Editing",
}
# Modality state letters of the code.
STATE_NAMES = {"O": "original", "M": "manipulated", "N": "null"}
# Label value that encodes class 0 per dataset; everything else is class 1.
REAL_VALUES = {"fakett": "real", "fakesv": "真"}
# Marker in an id whose visual output is untouched: motion features come from the seed.
UNTOUCHED_VISUAL = "TMVO"
# Characters that Python's ``str.strip`` removes, as a regex class body.
WHITE_SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seed_id(video_id) -> Column:
    """Text before the first ``_`` (the whole id when there is none)."""
    return F.split_part(_c(video_id), F.lit("_"), F.lit(1))


def fabrication_code(video_id) -> Column:
    """Everything after the first ``_``; NULL for ids without one."""
    v = _c(video_id)
    pos = F.instr(v, "_")
    return F.when(pos > 0, F.substr(v, pos + F.lit(1)))


def _state(code: Column, idx: int) -> Column:
    letter = F.substr(code, F.lit(idx), F.lit(1))
    out = None
    for k, name in STATE_NAMES.items():
        out = (F.when(letter == k, F.lit(name)) if out is None
               else out.when(letter == k, F.lit(name)))
    return out


def fabrication_fields(video_id) -> dict[str, Column]:
    """``<seed>_T?V?_T?V?`` -> seed, code, four modality states, type name."""
    code = fabrication_code(video_id)
    well_formed = code.rlike(r"^T[OMN]V[OMN]_T[OMN]V[OMN]$")
    ftype = None
    for k, name in FABRICATION_TYPES.items():
        ftype = (F.when(code == k, F.lit(name)) if ftype is None
                 else ftype.when(code == k, F.lit(name)))
    ftype = ftype.otherwise(F.when(well_formed, F.lit("other")))
    good = lambda c: F.when(well_formed, c)
    return {
        "seed_id": seed_id(video_id),
        "fabrication_code": code,
        "in_text": good(_state(code, 2)),
        "in_visual": good(_state(code, 4)),
        "out_text": good(_state(code, 7)),
        "out_visual": good(_state(code, 9)),
        "fabrication_type": ftype,
    }


def clip_fields(clip) -> dict[str, Column]:
    """``<src>_S<start>_E<end>`` -> src, s, e (end inclusive). A part that is
    missing or not an integer gives NULL, so callers can quarantine it."""
    c = _c(clip)
    p1 = F.split_part(c, F.lit("_"), F.lit(2))
    p2 = F.split_part(c, F.lit("_"), F.lit(3))
    to_int = lambda p: F.when(F.length(p) > 1, F.substr(p, F.lit(2)).try_cast("int"))
    return {"src": F.split_part(c, F.lit("_"), F.lit(1)), "s": to_int(p1), "e": to_int(p2)}


def audio_key(visual_materials) -> Column:
    """Audio features are keyed by the first material's source video."""
    return F.split_part(F.try_element_at(_c(visual_materials), F.lit(1)), F.lit("_"), F.lit(1))


def motion_key(video_id) -> Column:
    """Untouched visual output -> the seed's motion features, else the item's own."""
    v = _c(video_id)
    return F.when(F.contains(v, F.lit(UNTOUCHED_VISUAL)), seed_id(v)).otherwise(v)


def encode_label(label, real_value: str = REAL_VALUES["fakett"]) -> Column:
    """``real_value`` -> 0, anything else (NULL included) -> 1."""
    return F.when(_c(label).eqNullSafe(F.lit(real_value)), F.lit(0)).otherwise(F.lit(1))


def strip_ws(c) -> Column:
    """Python ``str.strip()``: leading and trailing white space of any script
    (``trim`` removes spaces only, Java's ``\\s`` ASCII only)."""
    return F.regexp_replace(_c(c), f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")
