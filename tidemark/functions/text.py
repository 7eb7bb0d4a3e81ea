"""Scalar functions on identity text, paths, dates and numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vessel names that are only a kind of vessel, and the word of doubt.
GENERIC_NAMES = ("motorboat", "sailboat", "fishboat", "mussel boat", "pilot ship", "tugboat", "yacht", "zodiac", "small yacht", "high speed motorboat", "dredger", "velero", "lancha", "boat")
DOUBT = "duda"

# Collection letters that are recorded by glider, hold the closest point of approach, are mostly background.
GLIDER_COLLECTIONS = ("F", "G", "H")
CPA_COLLECTIONS = ("A", "C", "F")
BACKGROUND_COLLECTIONS = ("E", "H")

# Weather words of ambient file names in the order in which they are tried; named rain states.
AMBIENT_WORDS = (("lluvia", "rain"), ("viento", "wind"), ("oleaje", "waves"), ("corriente", "current"))
RAIN_STATES = ("no rain", "light", "moderate", "heavy", "very heavy")


def mmsi(c: Column) -> Column:
    """Digits after ``mmsi=`` in any case; null if there are none."""
    return F.nullif(F.regexp_extract(c, r"(?i)mmsi=(\d+)", 1), F.lit(""))


def state(c: Column) -> Column:
    """The first parenthetical, trimmed and lower-cased; empty if there is none."""
    return F.trim(F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"\((.*?)\)", 1)))


def name_identity(c: Column) -> Column:
    """A quoted name, else the name without parentheticals and doubled spaces; trimmed and lower-cased."""
    quoted = F.regexp_extract(c, r'"(.*?)"', 1)
    bare = F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), r"\s+", " ")
    return F.lower(F.trim(F.when(c.rlike(r'"(.*?)"'), quoted).otherwise(bare)))


def is_uncertain(name: Column) -> Column:
    """A bare kind of vessel without a number or a quoted name, or a word of doubt."""
    ident = name_identity(name)
    bare = ~F.contains(name, F.lit('"')) & ~ident.rlike(r"\d") & ident.isin(*GENERIC_NAMES)
    return F.coalesce(bare | F.lower(name).contains(DOUBT), F.lit(False))


def identity_confidence(name: Column, link: Column) -> Column:
    """An MMSI beats doubt here, unlike in the key."""
    return F.when(mmsi(link).isNotNull(), "mmsi").when(is_uncertain(name), "uncertain").otherwise("named")


def identity_key(name: Column, link: Column, recording: Column) -> Column:
    """Doubt beats an MMSI, which beats a name: an uncertain vessel stands for its recording only."""
    return F.when(is_uncertain(name), F.concat(F.lit("rec:"), recording.cast("string"))).when(mmsi(link).isNotNull(), F.concat(F.lit("mmsi:"), mmsi(link))).otherwise(F.concat(F.lit("name:"), name_identity(name)))


def number_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def day(c: Column) -> Column:
    return c.try_cast("date")


def is_ambient(c: Column) -> Column:
    return F.coalesce(F.lower(c).contains("ambient"), F.lit(False))


def safe_name(c: Column) -> Column:
    """Anything but letters, digits, minus, underscore and dot becomes an underscore."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_")


def collection_path(root: str, collection: Column, number: Column) -> Column:
    return F.format_string(f"{root}/%s/%s-%04d.wav", collection, collection, number.cast("long"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def clip_stem(source: Column, collection: Column, recording: Column, file: Column) -> Column:
    """Collection and number for numbered sources, else the file name without its ending."""
    return F.when(source == "IARA", F.format_string("%s-%04d", collection, recording.cast("long"))).otherwise(stem(file))


def recording_number(source: Column, clip: Column) -> Column:
    """Number within a clip name: the last ``-`` part, or the first ``__`` part; an error for another source or no number."""
    part = F.when(F.upper(source) == "IARA", F.substring_index(clip, "-", -1)).when(F.upper(source) == "SHIPSEAR", F.substring_index(clip, "__", 1))
    return F.coalesce(part.try_cast("long").cast("string"), F.raise_error(F.concat(F.lit("no recording number in "), clip)).cast("string"))


def short_label(vessel: Column, session: Column) -> Column:
    head = F.when(vessel.startswith("SHIPSEAR:"), F.concat(F.lit("SE:"), F.substring_index(vessel, ":", -1))).otherwise(vessel)
    tail = F.when(F.contains(session, F.lit("#")), F.regexp_replace(session, "^[^#]*#", "")).otherwise(session)
    return F.concat(head, F.lit("/"), tail)


def rain_bucket(state_: Column, mm: Column) -> Column:
    """A named state, else a class by millimetres: none at 0, light below 0.5, moderate below 2, heavy; unknown without either."""
    low, amount = F.lower(F.trim(state_)), mm.try_cast("double")
    named = F.replace(low, F.lit(" "), F.lit("_"))
    return F.when(low.isin(*RAIN_STATES), named).when(amount.isNull(), "unknown").when(amount == 0, "no_rain").when(amount < 0.5, "light").when(amount < 2, "moderate").otherwise("heavy")


def ambient_condition(file: Column) -> Column:
    low, out = F.lower(file), None
    for word, name in AMBIENT_WORDS:
        out = F.when(low.contains(word), name) if out is None else out.when(low.contains(word), name)
    return out.otherwise("ambient")


def tensor_name(c: Column) -> Column:
    """Parts of ``<clip>__<piece>__<condition>__seg<number>``, split from the right."""
    name = stem(c)
    parts = F.split(name, "__")
    n = F.size(parts)
    return F.struct(
        F.array_join(F.slice(parts, 1, F.greatest(n - 3, F.lit(1))), "__").alias("clip_id"),
        F.try_element_at(parts, F.lit(-3)).alias("piece"),
        F.try_element_at(parts, F.lit(-2)).alias("condition"),
        F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"(\d+)$", 1).try_cast("int").alias("seg_index"),
    )


def passage_number(uid: Column) -> Column:
    return F.substring_index(uid, "_p", -1).try_cast("int")


def slashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def clip_id(folder: Column, file: Column) -> Column:
    return F.replace(F.concat_ws("__", folder, stem(file)), F.lit(" "), F.lit("_"))


def platform(letter: Column) -> Column:
    return F.when(letter.isin(*GLIDER_COLLECTIONS), "Glider").otherwise("OS")


def has_cpa(letter: Column) -> Column:
    return letter.isin(*CPA_COLLECTIONS)


def is_background(letter: Column) -> Column:
    return letter.isin(*BACKGROUND_COLLECTIONS)


def provenance(piece: Column, condition: Column, value: Column, about: str) -> Column:
    """A value that only tells something of query pieces whose condition contains ``about``."""
    return F.when((piece == "query") & condition.contains(about), value)


def encode_lines(lines: Column) -> Column:
    """Tonal lines as ``freq:dB`` with three and two decimals, joined by semicolons."""
    return F.array_join(F.transform(lines, lambda x: F.format_string("%.3f:%.2f", x["freq_hz"], x["mean_db"])), ";")


def decode_lines(text: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).try_cast("double").alias("freq_hz"), F.substring_index(x, ":", -1).try_cast("double").alias("mean_db")))


def decibel(power: Column) -> Column:
    return 10 * F.log10(F.greatest(power, F.lit(1e-10)))


def display_band(score: Column, high: float, low: float) -> Column:
    return F.when(score >= high, "strong").when(score >= low, "possible").otherwise("weak")


def duration(frames: Column, rate: Column) -> Column:
    return F.coalesce(F.try_divide(frames.cast("double"), rate.cast("double")), F.lit(0.0))


def set_number(epoch: Column, sets: int = 25) -> Column:
    return (epoch - 1) % sets + 1


def learning_rate(epoch: Column, base: float, epochs: int, warm: int = 3, floor: float = 1e-6) -> Column:
    """Linear warm-up, then a half cosine down to the floor."""
    rise = base * epoch / warm
    share = (epoch - warm) / F.lit(float(max(1, epochs - warm)))
    return F.when(epoch <= warm, rise).otherwise(floor + 0.5 * (base - floor) * (1 + F.cos(F.lit(3.141592653589793) * share)))


def seeded(seed: int, *keys: str) -> Column:
    """A reproducible order: the MD5 of the seed and the keys, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))
