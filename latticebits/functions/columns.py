"""Scalar expressions of the graph operators: parsing, cleaning, geometry, code length. All stay inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")
#: Probabilities are clipped to this distance from 0 and 1 before a code length is taken. Fixed value.
CLIP = 1e-12
#: Voxel edge lengths in nm. Fixed values.
VOXEL_NM = (8, 8, 33)
#: Labels that count as neurons. Fixed values.
NEURON_LABELS = ("PYRAMIDAL", "INTERNEURON", "SPINY_ATYPICAL", "SPINY_STELLATE", "UNCLASSIFIED_NEURON")
#: Short and long names of cell types. Fixed values.
TYPE_NAMES = {"e": "excitatory", "i": "inhibitory", "g": "glia"}
TRUE_WORDS = ("t", "true", "1", "yes")
FEATURE_SETS = ("distance", "relative", "spatial")


def is_finite(c: Column) -> Column:
    """True for numbers; false for null, NaN and infinities."""
    x = c.cast("double")
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INFINITY)), F.lit(False))


def status_true(c: Column) -> Column:
    """Boolean-like text: t, true, 1, yes in any case; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def coerced_id(c: Column) -> Column:
    """Text to BIGINT, null where it isn't a whole number; never by way of DOUBLE, so ids above 2**53 stay exact."""
    text = F.trim(c.cast("string"))
    wide = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast("bigint"), F.when(wide == F.floor(wide), wide.try_cast("bigint")))


def coerced_double(c: Column) -> Column:
    """Text to a finite DOUBLE, else null."""
    x = F.trim(c.cast("string")).try_cast("double")
    return F.when(is_finite(x), x)


def normal_type(c: Column) -> Column:
    """Cell type: trimmed, lower case, short names written out, null and empty to `unknown`."""
    low = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("unknown"))))
    named = reduce(lambda acc, kv: F.when(low == kv[0], kv[1]).otherwise(acc), TYPE_NAMES.items(), low)
    return F.when(named == "", "unknown").otherwise(named)


def known_type(c: Column) -> Column:
    """Null to `unknown`, all else as text."""
    return F.coalesce(c.cast("string"), F.lit("unknown"))


def is_neuron(c: Column) -> Column:
    return F.coalesce(F.upper(F.trim(c)).isin(*NEURON_LABELS), F.lit(False))


def voxel_nm(c: Column, axis: int) -> Column:
    return c * F.lit(VOXEL_NM[axis])


def json_identity(v: Column, path: str) -> Column:
    """A neuron id inside a VARIANT: whole JSON numbers and strings of digits; null for null, booleans and others."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.try_variant_get(v, path, "string")
    whole = kind.startswith("BIGINT") | ((kind == "STRING") & text.rlike(r"^\s*[0-9]+\s*$")) | kind.rlike(r"^DECIMAL\((19|20),0\)$")
    return F.when(whole, F.trim(text).try_cast("decimal(20,0)"))


def exact_integer(c: Column, minimum: int | None = None, name: str = "value") -> Column:
    """Text that is a plain decimal integer (no leading zeros, no fraction) as BIGINT; an error else."""
    text = c.cast("string")
    good = text.rlike("^-?(0|[1-9][0-9]*)$")
    value = text.try_cast("bigint")
    if minimum is not None:
        good = good & (value >= minimum)
    return F.when(F.coalesce(good & value.isNotNull(), F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{name} is not an exact integer: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def session_of(c: Column) -> Column:
    """`9-scan-4` to struct(session, scan_idx); an error for other forms."""
    good = c.rlike("^[0-9]+-scan-[0-9]+$")
    part = F.split(c, "-")
    return F.when(good, F.struct(part[0].try_cast("int").alias("session"), part[2].try_cast("int").alias("scan_idx"))).otherwise(F.raise_error(F.concat(F.lit("not a session id: "), F.coalesce(c, F.lit("null")))).cast("struct<session: int, scan_idx: int>"))


def session_of_path(c: Column) -> Column:
    """struct(session, scan_idx) of the one `_ses-N-scan-N_` in a path; an error unless there is exactly one."""
    found = F.regexp_extract_all(c, F.lit(r"_ses-([0-9]+)-scan-([0-9]+)_"), 1)
    scans = F.regexp_extract_all(c, F.lit(r"_ses-([0-9]+)-scan-([0-9]+)_"), 2)
    return F.when(F.size(found) == 1, F.struct(found[0].cast("int").alias("session"), scans[0].cast("int").alias("scan_idx"))).otherwise(F.raise_error(F.concat(F.lit("no single session in path: "), F.coalesce(c, F.lit("null")))).cast("struct<session: int, scan_idx: int>"))


def length3(dx: Column, dy: Column, dz: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def geometry_features(feature_set: str, d: str = "distance", s: tuple[str, ...] = ("sx", "sy", "sz"), t: tuple[str, ...] = ("tx", "ty", "tz")) -> dict[str, Column]:
    """Named feature columns: 1 (distance), 7 (relative) or 16 (spatial)."""
    if feature_set not in FEATURE_SETS:
        raise ValueError(f"feature_set must be one of {', '.join(FEATURE_SETS)}")
    out = {"f_log_distance": F.log1p(F.col(d))}
    if feature_set == "distance":
        return out
    delta = [F.col(b) - F.col(a) for a, b in zip(s, t)]
    length = F.greatest(F.col(d), F.lit(1e-12))
    out |= {f"f_abs_{axis}": F.abs(x) for axis, x in zip("xyz", delta)}
    out |= {f"f_unit_{axis}": x / length for axis, x in zip("xyz", delta)}
    if feature_set == "spatial":
        out |= {f"f_source_{axis}": F.col(c) for axis, c in zip("xyz", s)}
        out |= {f"f_target_{axis}": F.col(c) for axis, c in zip("xyz", t)}
        out |= {f"f_middle_{axis}": (F.col(a) + F.col(b)) / 2 for axis, a, b in zip("xyz", s, t)}
    return out


def clipped(p: Column) -> Column:
    """p within [CLIP, 1-CLIP]; an error for null, NaN or infinite p, which greatest() and least() would hide."""
    return F.when(is_finite(p), F.greatest(F.least(p, F.lit(1 - CLIP)), F.lit(CLIP))).otherwise(F.raise_error(F.lit("probabilities must be finite")).cast("double"))


def surprisal(p: Column) -> Column:
    """Bits of an event of probability p."""
    return -F.log2(clipped(p))


def code_length(y: Column, p: Column) -> Column:
    """Bits of a 0/1 label under p, one row's term; an error for other labels."""
    q = clipped(p)
    return F.when(y == 1, -F.log2(q)).when(y == 0, -F.log2(1 - q)).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))


def entropy_bits(p: Column) -> Column:
    """Bernoulli entropy, 0 at 0 and 1; an error outside [0, 1]."""
    inside = -p * F.log2(p) - (1 - p) * F.log2(1 - p)
    return F.when((p == 0) | (p == 1), F.lit(0.0)).when((p > 0) & (p < 1), inside).otherwise(F.raise_error(F.lit("p must be in [0, 1]")).cast("double"))


def per_sample(bits: Column, n: Column) -> Column:
    return F.when(n > 0, bits / n).otherwise(F.raise_error(F.lit("no samples")).cast("double"))


def per_positive(bits: Column, positives: Column) -> Column:
    return F.when(positives > 0, bits / positives).otherwise(F.raise_error(F.lit("no positive samples")).cast("double"))


def smoothed_rate(k: Column, n: Column, alpha: float = 0.5) -> Column:
    return (k + F.lit(alpha)) / (n + F.lit(2 * alpha))


def bin_of(d: Column, interior: Column) -> Column:
    """Index of the right-closed bin: how many interior edges are at or below d."""
    return F.size(F.filter(interior, lambda e: e <= d))


def sigmoid(z: Column) -> Column:
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def source_choice(n_bytes: Column, limit: int = 2 * 1024**3, single: str = "single-file", sharded: str = "shards") -> Column:
    """Where connectivity is read from: the single file if its size is known, above 0 and at most limit, else the shards."""
    return F.when((n_bytes > 0) & (n_bytes <= limit), F.lit(single)).otherwise(F.lit(sharded))
