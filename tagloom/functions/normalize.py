"""Scalar clean-up of recognised text and numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Recognition repairs, applied in this order.
REPAIRS = [
    (r"(?<=[A-Z])0(?=[A-Z])", "O"), (r"(?<=[A-Z])1(?=[A-Z])", "I"), (r"(?<=[0-9])[Ol](?=[0-9])", "0"),
    (r"\bFCllS\b", "FC11S"), (r"\bFCIIS\b", "FC11S"), (r"\bGCllS\b", "GC11S"), (r"\bACZlS\b", "AC21S"), (r"\bAS2OS\b", "AS20S"),
    (r"\bPlT\b", "PIT"), (r"\bTlT\b", "TIT"), (r"\bFlT\b", "FIT"), (r"\bLlT\b", "LIT"), (r"\bAlT\b", "AIT"), (r"\bPDl\b", "PDI"), (r"\bPDlT\b", "PDIT"),
]


#: White space of any script, in a class that Java and RE2 read alike.
WHITE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _re(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def clean_text(c: Column) -> Column:
    """Line breaks and runs of white space to one blank, trimmed."""
    return F.when(c.rlike(f"(?! ){WHITE}|  "), F.trim(_re(c, WHITE + "+", " "))).otherwise(F.trim(c))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return _re(c, f"^{WHITE}+|{WHITE}+$")


def repair(c: Column) -> Column:
    """The repairs one after another; a text that none of them meets is passed by after one look."""
    met = c.rlike("|".join(p for p, _ in REPAIRS))
    return F.when(met, reduce(lambda x, r: _re(x, *r), REPAIRS, c)).otherwise(c)


def canonical_tag(c: Column) -> Column:
    """Trimmed, upper-cased, without one leading area number."""
    return _re(F.upper(strip(c)), "^[0-9]{2,3}-")


def equipment_key(c: Column) -> Column:
    return _re(_re(F.upper(c), "^[0-9]{2,3}-"), "-[A-Z][A-Z0-9]{0,3}$")


def instrument_key(c: Column) -> Column:
    return _re(F.upper(c), "^[0-9]{2,3}-")


def valve_key(c: Column) -> Column:
    return _re(F.upper(c), "^[0-9]{2,3}-?")


def twin_key(c: Column) -> Column:
    """The canonical tag without one trailing capital: relief valves A and B of one position."""
    return _re(canonical_tag(c), "[A-Z]$")


def strip_notes(c: Column) -> Column:
    """A line tag without references to notes and trailing dashes."""
    return _re(F.trim(_re(c, r"(?i)\s*NOTE\s*[0-9]+")), "-+$")


def line_tag(c: Column) -> Column:
    """A raw line match as a tag; null where fewer than 4 characters stay."""
    t = F.upper(_re(strip_notes(c), r"\s+"))
    return F.when(F.length(t) >= 4, t)


def page_x(c: Column, width: float = 3300.0) -> Column:
    """A pixel position as share of the page; values up to 1 are shares already."""
    return F.when(c > 1, c / width).otherwise(c)


def page_y(c: Column, height: float = 2338.0) -> Column:
    return F.when(c > 1, c / height).otherwise(c)


def duration(seconds: Column) -> Column:
    """N/A for none or zero, seconds with one decimal below a minute, else minutes and seconds."""
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "N/A").when(seconds < 60, F.format_string("%.1fs", seconds)).otherwise(F.format_string("%02dm %02ds", F.floor(seconds / 60), F.floor(seconds % 60)))


def pressure_text(c: Column) -> Column:
    """One spelling of gauge bar, with a blank before it."""
    t = _re(_re(_re(c, r"\s+", " "), r"(?i)bar\s*\(g\)", "bar(g)"), "(?i)barg", "bar(g)")
    return F.when(t.rlike(r"\s+bar\(g\)"), t).otherwise(_re(t, r"bar\(g\)", " bar(g)"))


def number_text(c: Column) -> Column:
    """A double to six places at most, without exponent or idle zeros."""
    t = F.regexp_replace(F.format_string("%.6f", c), "0+$", "")
    return F.when(c.isNull(), None).when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t)


def position(center: Column, box: Column, low: int) -> Column:
    """A share of the page from a centre, else from the middle of a box (ymin, xmin, ymax, xmax; low is 0 for y, 1 for x), else 0.5; -1 counts as no centre. Pixels become shares."""
    middle = F.when(F.size(box) >= 4, (F.get(box, F.lit(low)) + F.get(box, F.lit(low + 2))) / 2)
    share = page_y if low == 0 else page_x
    return share(F.coalesce(F.when(center != -1, center), middle, F.lit(0.5)))
