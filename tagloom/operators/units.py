"""Quantities written as free text in many units, converted to one unit per kind of quantity.

A value is read by a small grammar: numbers, unit expressions, separators, and words whose digits
are no numbers. A unit expression is a product and quotient of atoms with powers; its dimension is
a vector of exponents over mass, length, time and temperature, and that vector, not the spelling,
decides the kind of quantity. Conversion applies scale and offset to the kind's canonical unit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.session import ship

# Atoms of unit expressions as (scale to SI, exponents of kg, m, s, K).
MASS, LENGTH, TIME, TEMPERATURE, FORCE, PRESSURE, POWER, ENERGY, VOLUME, RATE, FLOW = (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (1, 1, -2, 0), (1, -1, -2, 0), (1, 2, -3, 0), (1, 2, -2, 0), (0, 3, 0, 0), (1, 0, -1, 0), (0, 3, -1, 0)
LB, G, GALLON, BTU, CALORIE, HP = 0.45359237, 9.80665, 0.003785411784, 1055.05585262, 4.1868, 745.69987158227
ATOMS: dict[str, tuple[float, tuple[int, int, int, int]]] = {
    "kg": (1, MASS), "kgs": (1, MASS), "g": (1e-3, MASS), "t": (1e3, MASS), "te": (1e3, MASS), "tonne": (1e3, MASS), "tonnes": (1e3, MASS), "mt": (1e3, MASS), "lb": (LB, MASS), "lbs": (LB, MASS), "klb": (1e3 * LB, MASS), "klbs": (1e3 * LB, MASS),
    "m": (1, LENGTH), "cm": (1e-2, LENGTH), "mm": (1e-3, LENGTH), "in": (0.0254, LENGTH), "ft": (0.3048, LENGTH),
    "s": (1, TIME), "sec": (1, TIME), "min": (60, TIME), "h": (3600, TIME), "hr": (3600, TIME), "hour": (3600, TIME), "d": (86400, TIME), "day": (86400, TIME),
    "kgf": (G, FORCE), "lbf": (LB * G, FORCE), "n": (1, FORCE), "kn": (1e3, FORCE),
    "pa": (1, PRESSURE), "kpa": (1e3, PRESSURE), "mpa": (1e6, PRESSURE), "hpa": (1e2, PRESSURE), "bar": (1e5, PRESSURE), "bars": (1e5, PRESSURE), "mbar": (1e2, PRESSURE), "psi": (LB * G / 0.0254**2, PRESSURE), "atm": (101325, PRESSURE),
    "w": (1, POWER), "watt": (1, POWER), "watts": (1, POWER), "kw": (1e3, POWER), "kilowatt": (1e3, POWER), "kilowatts": (1e3, POWER), "mw": (1e6, POWER), "megawatt": (1e6, POWER), "megawatts": (1e6, POWER), "hp": (HP, POWER), "bhp": (HP, POWER), "h.p.": (HP, POWER), "h.p": (HP, POWER),
    "j": (1, ENERGY), "kj": (1e3, ENERGY), "mj": (1e6, ENERGY), "gj": (1e9, ENERGY), "cal": (CALORIE, ENERGY), "kcal": (1e3 * CALORIE, ENERGY), "mcal": (1e6 * CALORIE, ENERGY), "gcal": (1e9 * CALORIE, ENERGY), "btu": (BTU, ENERGY), "kbtu": (1e3 * BTU, ENERGY), "mbtu": (1e3 * BTU, ENERGY), "mmbtu": (1e6 * BTU, ENERGY),
    "l": (1e-3, VOLUME), "ltr": (1e-3, VOLUME), "litre": (1e-3, VOLUME), "litres": (1e-3, VOLUME), "liter": (1e-3, VOLUME), "liters": (1e-3, VOLUME), "gal": (GALLON, VOLUME), "usgal": (GALLON, VOLUME), "us gal": (GALLON, VOLUME), "cu.m": (1, VOLUME), "cum": (1, VOLUME), "cu m": (1, VOLUME), "cu.ft": (0.3048**3, VOLUME), "bbl": (42 * GALLON, VOLUME),
    "tph": (1e3 / 3600, RATE), "kgph": (1 / 3600, RATE), "kgh": (1 / 3600, RATE), "pph": (LB / 3600, RATE), "lbh": (LB / 3600, RATE), "kpph": (1e3 * LB / 3600, RATE),
    "gpm": (GALLON / 60, FLOW), "usgpm": (GALLON / 60, FLOW), "us gpm": (GALLON / 60, FLOW), "gph": (GALLON / 3600, FLOW), "lpm": (1e-3 / 60, FLOW), "lps": (1e-3, FLOW), "lph": (1e-3 / 3600, FLOW), "cmh": (1 / 3600, FLOW), "cfm": (0.3048**3 / 60, FLOW), "bpd": (42 * GALLON / 86400, FLOW),
}
# Temperature units as (scale to K, offset in K).
THERMAL = {"c": (1.0, 273.15), "celsius": (1.0, 273.15), "centigrade": (1.0, 273.15), "f": (5 / 9, 459.67 * 5 / 9), "fahrenheit": (5 / 9, 459.67 * 5 / 9), "k": (1.0, 0.0), "kelvin": (1.0, 0.0)}
# Kind of quantity by exponents, with its canonical unit's scale and offset in SI (kPa gauge, degC, kg/h, m3/h, kW).
ATMOSPHERE = 101325.0
KINDS = {PRESSURE: ("pressure", 1e3, 0.0), TEMPERATURE: ("temperature", 1.0, 273.15), RATE: ("mass_flow", 1 / 3600, 0.0), FLOW: ("volume_flow", 1 / 3600, 0.0), POWER: ("duty", 1e3, 0.0)}


class Field(NamedTuple):
    """A text column: its name, the source column with the unit of bare numbers, what a description calls it, and the dimensions it may have."""

    name: str
    default: str
    said: str
    dims: tuple


FIELDS = (
    Field("design_pressure", "pressure_unit", r"press(?:ures?)?", (PRESSURE,)),
    Field("design_temperature", "temperature_unit", r"temp(?:eratures?|s)?", (TEMPERATURE,)),
    Field("flow_rate", "flow_unit", r"flow(?:s|[ -]?rates?)?", (RATE, FLOW)),
    Field("duty", "duty_unit", r"dut(?:y|ies)", (POWER,)),
)

_CHARS = str.maketrans({"−": "-", "–": "-", "—": "-", "‑": "-", "‐": "-", "℃": "°c", "℉": "°f", "º": "°", "˚": "°", "²": "2", "³": "3", " ": " ", " ": " ", " ": " ", " ": " ", "\t": " ", "\n": " ", "\r": " ", "’": "'", "·": ".", "К": "k"})
_ATOM = "|".join(re.escape(a) for a in sorted(ATOMS, key=len, reverse=True))
_FACTOR = rf"(?:{_ATOM})(?:\^?[23](?![0-9]))?"
_EXPR = rf"{_FACTOR}(?: ?[/*] ?{_FACTOR})*(?![a-z])"
_MARK = r"(?: ?\( ?(?P<m1>g|a|abs|gauge) ?\)| ?(?P<m2>gauge|abs(?:olute)?)(?![a-z])| (?P<m3>[ga])(?![a-z])|(?P<m4>[ga])(?![a-z]))?"
_PRESSED = rf"(?:{'|'.join(re.escape(a) for a in sorted((a for a, (_, d) in ATOMS.items() if d == PRESSURE), key=len, reverse=True))}|(?:kgf?|lbf?|n|kn) ?/ ?(?:cm|mm|in|ft|m) ?\^?2(?![0-9]))"
_UNIT = {
    PRESSURE: re.compile(rf"(?P<u>{_PRESSED}){_MARK}(?![a-z])"),
    TEMPERATURE: re.compile(r"(?:°|deg(?:rees?)?\.?)? ?(?P<u>celsius|centigrade|fahrenheit|kelvin|[cfk])(?![a-z])\.?"),
}
_OTHER = re.compile(rf"(?P<u>{_EXPR})")
_NUMBER = re.compile(r"[0-9]+(?:[ ',][0-9]{3}(?![0-9]))+(?:[.,][0-9]+)?|[0-9]*[.,]?[0-9]+")
_VACUUM = re.compile(r"(?:f\. ?v\.?|fv|full vac(?:uum)?)(?![a-z])")
_NOTE = re.compile(r"(?:notes?|holds?|class|cl|rating|rev|sheet|sht|dwg|item|pn|ansi|asme|spec|ref|see)(?![a-z])[ .:#-]*(?:no(?![a-z])\.? ?)?(?:[0-9]+[a-z]?(?:(?: ?[,&] ?| and )[0-9]+)*)?|cl[0-9]+|pn[0-9]+")
_CLASS = re.compile(r"[0-9]+ ?(?:#|lbs? class|class(?![a-z])|%)(?: ?class)?")
_SEPARATOR = re.compile(r"[/;&]|to(?![a-z])|and(?![a-z])|\.\.+")
_WORD = re.compile(r"[a-z]+")
_SAID = {f.name: re.compile(rf"(?<![a-z]){f.said}(?![a-z])(?P<link>(?: ?[:=]| +(?:is|are|all|given|stated|shown|quoted|in|as|units?|of))*) *(?P<open>[\[(]?)") for f in FIELDS}
_GOES_ON = re.compile(rf" +(?!(?:{'|'.join(f.said for f in FIELDS)})(?![a-z]))[a-z]")


class Unit(NamedTuple):
    """scale and offset to SI, the exponents, and for pressures whether it is absolute."""

    scale: float
    offset: float
    dims: tuple
    absolute: bool = False


def _unit_at(field: Field, s: str, at: int) -> tuple[Unit, int] | None:
    """The longest unit expression of the field's dimensions that begins here."""
    m = _UNIT.get(field.dims[0], _OTHER).match(s, at)
    if not m:
        return None
    u = m["u"]
    if field.dims[0] == TEMPERATURE:
        scale, offset = THERMAL[u]
        return Unit(scale, offset, TEMPERATURE), m.end()
    scale, dims = expression(u)
    if field.dims[0] == PRESSURE:
        mark = next((m[g] for g in ("m1", "m2", "m3", "m4") if m[g]), "g")
        if dims == (1, -2, 0, 0):  # a mass on an area is meant as its weight
            scale, dims = scale * G, PRESSURE
        return (Unit(scale, 0.0, dims, mark.startswith("a")), m.end()) if dims == PRESSURE else None
    return (Unit(scale, 0.0, dims), m.end()) if dims in field.dims else None


@lru_cache(4096)
def expression(text: str) -> tuple[float, tuple]:
    """Scale and exponents of a product and quotient of atoms."""
    scale, dims, sign = 1.0, [0, 0, 0, 0], 1
    for part in re.split(r"( ?[/*] ?)", text):
        if part.strip() in ("/", "*"):
            sign = -1 if "/" in part else 1
            continue
        m = re.fullmatch(rf"({_ATOM}) ?\^?([23])?", part)
        power = sign * int(m[2] or 1)
        size, exps = ATOMS[m[1]]
        scale *= size**power
        dims = [d + e * power for d, e in zip(dims, exps)]
    return scale, tuple(dims)


def number(text: str) -> float:
    """A comma before exactly three digits, a blank or an apostrophe groups thousands; any other comma and every point is decimal."""
    text = re.sub(r"[ ',](?=[0-9]{3}(?![0-9]))", "", text)
    return float(text.replace(",", "."))


def read(field: Field, text: str) -> list[tuple[float | None, Unit | None]]:
    """The numbers of a value as written, each with its unit; None as number stands for full vacuum."""
    s = text.translate(_CHARS).lower()
    found: list[list] = []  # [number, unit]
    units: list[tuple[int, Unit]] = []  # unit and how many numbers came before it
    at, ahead, in_segment, glue = 0, None, False, False
    while at < len(s):
        c = s[at]
        if c in " []()":
            at += 1
            continue
        if c.isascii() and (c.isalpha() or c == "°"):
            if field.dims[0] == PRESSURE and (m := _VACUUM.match(s, at)):
                found.append([None, None])
                at, ahead, in_segment = m.end(), None, True
                continue
            if u := _unit_at(field, s, at):
                if in_segment and found and found[-1][1] is None and not glue:
                    found[-1][1] = u[0] if found[-1][0] is not None else None
                    glue = True  # the number has its unit; a further one would be the next number's
                else:
                    ahead = u[0]
                units.append((len(found), u[0]))
                at = u[1]
                continue
            m = _NOTE.match(s, at) or _SEPARATOR.match(s, at)
            if m and m.end() > at:
                if m.re is _SEPARATOR:
                    in_segment = glue = False
                    ahead = None
                at = m.end()
                continue
            at = _WORD.match(s, at).end() if _WORD.match(s, at) else at + 1
            continue
        if c.isdigit() and c.isascii() or c in ".,-+" and at + 1 < len(s):
            if m := _CLASS.match(s, at):
                at = m.end()
                continue
            sign = 1
            if c in "-+":
                if in_segment:  # between numbers: a range
                    at += 1
                    in_segment = glue = False
                    continue
                sign, at = (-1 if c == "-" else 1), at + 1
                while at < len(s) and s[at] == " ":
                    at += 1
            if m := _NUMBER.match(s, at):
                found.append([sign * number(m[0]), ahead])
                at, ahead, in_segment, glue = m.end(), None, True, found[-1][1] is not None
            elif s[at : at + 1] not in "+-":
                at += 1
            continue
        if m := _SEPARATOR.match(s, at):
            in_segment = glue = False
            ahead = None
            at = m.end()
            continue
        at += 1
    # Numbers without a unit of their own share the value's: the next one written, else the last before.
    for i, x in enumerate(found):
        if x[1] is None and units:
            x[1] = next((u for n, u in units if n > i), units[-1][1])
    return [tuple(x) for x in found]


@lru_cache(200_000)
def named_unit(field: Field, description: str) -> Unit | None:
    """The unit that a description names for the field: its name, words like 'given in' or a colon or bracket, then a unit.

    Without anything between name and unit ('pressures barg') the unit must end its phrase: in
    'Duty hp cooler' hp says which cooler it is.
    """
    s = description.translate(_CHARS).lower()
    for m in _SAID[field.name].finditer(s):
        u = _unit_at(field, s, m.end())
        if u and (m["link"] or m["open"] or s[u[1] - 1] == "." or not _GOES_ON.match(s, u[1])):
            return u[0]
    return None


@lru_cache(4096)
def default_unit(field: Field, text: str) -> Unit | None:
    u = _unit_at(field, text.translate(_CHARS).lower().strip(), 0)
    return u[0] if u else None


def canonical(value: float | None, unit: Unit) -> tuple[str, int]:
    """Kind and whole value in the kind's unit; None is full vacuum."""
    kind, scale, offset = KINDS[unit.dims]
    si = 0.0 if value is None else value * unit.scale + unit.offset
    if unit.dims == PRESSURE and (value is None or unit.absolute):
        si -= ATMOSPHERE
    x = (si - offset) / scale
    return kind, int(x + 0.5) if x >= 0 else -int(0.5 - x)


@lru_cache(500_000)
def _converted(field: Field, text: str, description: str | None, default: str | None) -> tuple[tuple[int, str, int], ...]:
    out = []
    other: Unit | None = None
    for pos, (x, unit) in enumerate(read(field, text)):
        if unit is None and x is not None:
            other = other or (description and named_unit(field, description)) or (default and default_unit(field, default)) or None
            unit = other
        if unit is None and x is None:
            unit = Unit(1.0, 0.0, PRESSURE, True)
        if unit is not None:
            out.append((pos, *canonical(x, unit)))
    return tuple(out)


def normalise(items: DataFrame, sources: DataFrame, item_id: str = "item_id", source_id: str = "source_id", description: str = "description", fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """One row per number: item_id, field_name, value_pos, quantity_kind, whole_value.

    A number's unit is the one standing with it, else the value's, else what the description names
    for the field, else the source's. Where none of these gives a unit (a null or unknown source)
    the number gives no row; its value_pos stays taken. Null and empty texts and texts without
    numbers give none. Repeated items give their rows each. Extra columns are not read.

    `sources` is a dimension of one row per source: it joins by id like any table, so Spark sends
    it around only where its size allows. Texts are parsed in Arrow batches, each distinct one once.
    """
    src = sources.select(F.col(source_id).alias("__sid"), *[F.col(f.default).alias(f"__u_{f.name}") for f in fields]).dropDuplicates(["__sid"])
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f.name).rlike(r"[0-9]|(?i)f\.? ?v|vac")
    given = items.select(item_id, source_id, description, *[f.name for f in fields]).where(some)
    joined = given.join(src, F.col(source_id) == F.col("__sid"), "left").select(item_id, description, *[f.name for f in fields], *[f"__u_{f.name}" for f in fields])
    id_type = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, names, pos, kinds, whole = [], [], [], [], []
            said = b.column(1).to_pylist()
            for j, f in enumerate(fields):
                units = b.column(2 + len(fields) + j).to_pylist()
                for i, text in enumerate(b.column(2 + j).to_pylist()):
                    if text:
                        for p, kind, x in _converted(f, text, said[i], units[i]):
                            own.append(i)
                            names.append(f.name)
                            pos.append(p)
                            kinds.append(kind)
                            whole.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(own, pa.int32())), pa.array(names, pa.string()), pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(whole, pa.int64())],
                names=[item_id, "field_name", "value_pos", "quantity_kind", "whole_value"],
            )

    ship(items.sparkSession)
    return joined.mapInArrow(run, f"`{item_id}` {id_type}, field_name string, value_pos int, quantity_kind string, whole_value long")
