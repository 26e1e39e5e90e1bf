"""Day-name, day-type and label-repair dictionaries, and the Columns built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: Hebrew weekday letters, Monday = 0 ---
WEEKDAY_LETTERS = {"א": 6, "ב": 0, "ג": 1, "ד": 2, "ה": 3, "ו": 4, "ש": 5}


def _spellings(letter: str) -> list[str]:
    return [f"יום {letter}", f"יום {letter}'", letter, f"{letter}'"]


DAY_NAMES = {text: day for letter, day in WEEKDAY_LETTERS.items() for text in _spellings(letter)}

# --- fixed values: day-type labels ---
DAY_TYPES = {
    "יום חול": "weekday",
    "חול": "weekday",
    "יום עבודה": "weekday",
    "עבודה": "weekday",
    "סוף שבוע": "weekend",
    "סופש": "weekend",
    "שבת": "weekend",
    "יום שבת": "weekend",
    "יום שישי": "weekend",
    "חג": "holiday",
    "יום חג": "holiday",
    "חגים": "holiday",
    "מועד": "holiday",
    "יום טוב": "holiday",
    "weekday": "weekday",
    "weekend": "weekend",
    "holiday": "holiday",
    "workday": "weekday",
    "work": "weekday",
}

# --- fixed values: known damaged labels and their repair ---
DAMAGED_LABELS = {
    "־¹־µ־½ֲ ־²": "יום ב",
    "־¹־µ־½ֲ ־³": "יום ג",
    "־¹־µ־½ֲ ־´": "יום ד",
    "־¹־µ־½ֲ ־µ": "יום ה",
    "־¹־µ־½ֲ ־¶": "יום ו",
    "־©־±־×": "שבת",
    "־¹־µ־½ֲ ־×": "יום א",
    "־¹־µ־½ ־—־µ־÷": "יום חול",
    "־©־±־×ֲ־×־³": "שבתות",
}
DAMAGE_MARKS = ("־", "ֲ")


def lookup(table: dict, key: Column) -> Column:
    """Value of a small literal dictionary, NULL when the key is absent."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def clean_label(label: Column) -> Column:
    """Trim, with no-break spaces treated as spaces."""
    return F.trim(F.translate(label, " ", " "))


def weekday_of_label(label: Column) -> Column:
    """Weekday index (Monday = 0) of a Hebrew day name, NULL when unknown."""
    return lookup(DAY_NAMES, clean_label(label))


def flat_daytype_mapping(custom: dict | None) -> dict[str, str]:
    """Default day types plus ``{category: label | [labels]}`` overrides."""
    table = dict(DAY_TYPES)
    for category, labels in (custom or {}).items():
        for label in [labels] if isinstance(labels, str) else labels:
            table[label] = category
    return table


def daytype_of_weekday(weekday: Column) -> Column:
    """Monday to Friday are weekdays."""
    return F.when(weekday < 5, "weekday").when(weekday.isNotNull(), "weekend")


def daytype_of_label(label: Column, weekday: Column, custom: dict | None = None) -> Column:
    """Mapped day type; unknown labels follow the weekday; a NULL label stays NULL."""
    mapped = lookup(flat_daytype_mapping(custom), clean_label(label))
    return F.when(label.isNotNull(), F.coalesce(mapped, daytype_of_weekday(weekday)))


def repair_label(label: Column, decode_bytes: bool = False) -> Column:
    """Undo known mojibake of day labels.

    ``decode_bytes`` adds the general re-decoding as windows-1255; it needs
    ``spark.sql.legacy.javaCharsets=true``.
    """
    marked = reduce(lambda a, b: a | b, [label.contains(m) for m in DAMAGE_MARKS])
    fallback = label
    if decode_bytes:
        kept = F.regexp_replace(label, r"[^\x00-ÿ]", "")
        again = F.decode(F.encode(kept, "ISO-8859-1"), "windows-1255")
        fallback = F.when(marked & (again != ""), again).otherwise(label)
    known = None
    for damaged, repaired in DAMAGED_LABELS.items():
        hit, fixed = label.contains(damaged), F.replace(label, F.lit(damaged), F.lit(repaired))
        known = F.when(hit, fixed) if known is None else known.when(hit, fixed)
    return known.otherwise(fallback)
