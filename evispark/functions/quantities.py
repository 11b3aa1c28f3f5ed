"""Parsing stated quantities out of text: numbers, ranges, lists, tolerances and two-part values with a unit spelling."""

from __future__ import annotations

import re
from functools import lru_cache

# The known conversions. unit spelling -> (quantity, scale, offset); common = value * scale + offset.
KNOWN: dict[str, tuple[str, float, float]] = {}


def _add(quantity: str, scale: float, names: str, offset: float = 0.0) -> None:
    for n in names.split("|"):
        KNOWN[n] = (quantity, scale, offset)


_add("mass", 1.0, "kg|kgs|kilogram|kilograms|kilogramme|kilogrammes")
_add("mass", 1e-3, "g|gram|grams|gramme|grammes|gm")
_add("mass", 1e-6, "mg|milligram|milligrams|milligramme|milligrammes")
_add("mass", 1e-9, "µg|ug|mcg|microgram|micrograms")
_add("mass", 1e3, "t|tonne|tonnes|metric tons")
_add("mass", 0.45359237, "lb|lbs|lb.|lbs.|pound|pounds")
_add("mass", 0.028349523125, "oz|oz.|ounce|ounces")
_add("duration", 1.0, "s|sec|secs|sec.|second|seconds")
_add("duration", 1e-3, "ms|msec|millisecond|milliseconds")
_add("duration", 1e-6, "µs|us|microsecond|microseconds")
_add("duration", 60.0, "min|mins|min.|minute|minutes")
_add("duration", 3600.0, "h|hr|hrs|h.|hr.|hrs.|hour|hours")
_add("duration", 86400.0, "d|day|days")
_add("duration", 604800.0, "wk|wks|week|weeks")
_add("duration", 31557600.0, "yr|yrs|year|years")
_add("temperature", 1.0, "K|kelvin|kelvins|Kelvin|deg K|°K")
_add("temperature", 1.0, "°C|℃|oC|ºC|deg C|deg. C|degC|celsius|Celsius|degree Celsius|degrees Celsius|degrees celsius|degrees C|degree C|centigrade|degrees centigrade", 273.15)
_add("temperature", 5 / 9, "°F|℉|oF|ºF|deg F|deg. F|degF|fahrenheit|Fahrenheit|degree Fahrenheit|degrees Fahrenheit|degrees fahrenheit|degrees F|degree F", 273.15 - 32 * 5 / 9)
_add("temperature", 5 / 9, "°R|rankine|Rankine|degrees Rankine")
_PER_MOL = ["{}/mol", "{} mol-1", "{} mol⁻¹", "{} mol^-1", "{} mol−1", "{}·mol-1", "{}·mol⁻¹", "{} per mole", "{} per mol", "{}mol-1", "{}mol⁻¹"]
for _u, _s in {"J": 1.0, "joule": 1.0, "joules": 1.0, "kJ": 1e3, "kilojoule": 1e3, "kilojoules": 1e3, "MJ": 1e6, "cal": 4.184, "calories": 4.184, "kcal": 4184.0, "kilocalorie": 4184.0, "kilocalories": 4184.0}.items():
    _add("energy", _s, "|".join(p.format(_u) for p in _PER_MOL))
_add("energy", 96485.33212, "eV|electronvolt|electronvolts|eV/atom|eV/molecule")
_add("length", 1.0, "m|metre|metres|meter|meters")
_add("length", 1e-2, "cm|centimetre|centimetres|centimeter|centimeters")
_add("length", 1e-3, "mm|millimetre|millimetres|millimeter|millimeters")
_add("length", 1e-6, "µm|um|micron|microns|micrometre|micrometres|micrometer|micrometers")
_add("length", 1e-9, "nm|nanometre|nanometres|nanometer|nanometers")
_add("length", 1e-10, "Å|A|angstrom|angstroms|Angstrom|Angstroms|ångström|ångströms|Ångström")
_add("length", 1e3, "km|kilometre|kilometres|kilometer|kilometers")
_add("length", 0.0254, "in.|inch|inches")
_add("length", 0.3048, "ft|ft.|foot|feet")
_ABS = ["{}", "{} abs.", "{} abs", "{} absolute", "{}(a)", "{} (a)", "{} (abs)", "{} (abs.)"]
for _u, _s in {"Pa": 1.0, "pascal": 1.0, "pascals": 1.0, "hPa": 1e2, "hectopascal": 1e2, "hectopascals": 1e2, "kPa": 1e3, "kilopascal": 1e3, "kilopascals": 1e3, "MPa": 1e6, "megapascal": 1e6, "megapascals": 1e6, "GPa": 1e9, "gigapascal": 1e9, "gigapascals": 1e9, "bar": 1e5, "bars": 1e5, "mbar": 1e2, "millibar": 1e2, "millibars": 1e2, "kbar": 1e8, "atm": 101325.0, "atmosphere": 101325.0, "atmospheres": 101325.0, "psi": 6894.757293168, "Torr": 101325 / 760, "torr": 101325 / 760, "mmHg": 133.322387415, "mm Hg": 133.322387415}.items():
    _add("pressure", _s, "|".join(p.format(_u) for p in _ABS))
_add("pressure", 1e5, "bara|bar a")
_add("pressure", 6894.757293168, "psia")
_add("pressure", 101325.0, "atma")
_PER = ["{}/{}", "{} {}-1", "{} {}⁻¹", "{} {}^-1", "{} {}−1", "{}·{}-1", "{}·{}⁻¹", "{} per {}"]
for _a, _g, _s in (("mol", "kg", 1.0), ("mmol", "g", 1.0), ("mol", "g", 1e3), ("mmol", "kg", 1e-3), ("µmol", "g", 1e-3), ("umol", "g", 1e-3), ("µmol", "mg", 1.0), ("mmol", "mg", 1e3), ("nmol", "g", 1e-6), ("kmol", "kg", 1e3)):
    _add("uptake", _s, "|".join(p.format(_a, _g) for p in _PER))
for _v, _s in (("cm3", 1.0), ("cm³", 1.0), ("cc", 1.0), ("ml", 1.0), ("mL", 1.0), ("cm^3", 1.0)):
    for _stp in ("(STP)", " (STP)", " STP", "STP"):
        for _g, _k in (("g", 1.0), ("kg", 1e-3)):
            _add("uptake", _s * _k / 22.414, "|".join(p.format(_v + _stp, _g) for p in [*_PER, "{} / {}"]))
for _v in ("L", "l", "dm3"):
    for _stp in ("(STP)", " (STP)", " STP", "STP"):
        _add("uptake", 1 / 22.414, "|".join(p.format(_v + _stp, "kg") for p in _PER))
        _add("uptake", 1e3 / 22.414, "|".join(p.format(_v + _stp, "g") for p in _PER))

_SUP = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺−", "0123456789-+-")
_GAP = "[    ]"
_NUM = rf"(?:\d{{1,3}}(?:[,'’]\d{{3}})+(?!\d)(?:\.\d+)?|\d{{1,3}}(?:{_GAP}\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
_EXP = rf"(?:{_GAP}?[x×·*]{_GAP}?10(?:\^?{{?[-−+]?\d+}}?|[⁻⁺]?[⁰¹²³⁴-⁹]+)|[eE][-+−]?\d+)?"
_VALUE = f"(?:[-−+])?{_NUM}{_EXP}"


_JOIN = r"\s*(?:±|\+/-|\+-)\s*|\s*(?:-|–|—|−|~|\.\.\.?|…)\s*|\s+(?:up\s+)?to\s+|\s*,\s*(?:and\s+|or\s+)?|\s+(?:and|or|&)\s+|\s+"


def _trie(words: set[str]) -> str:
    """A pattern for any of `words`, longest first, branching letter by letter (a flat alternation is tried word by word)."""
    heads: dict[str, set[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], set()).add(w[1:])
    if not heads:
        return ""
    parts = [(_GAP if c == " " else re.escape(c)) + _trie(rest) for c, rest in sorted(heads.items())]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return (f"(?:{body})?" if "" in words else body)


@lru_cache(maxsize=8)
def _compiled(extra: tuple[str, ...] = ()) -> tuple[re.Pattern, re.Pattern]:
    """(chain, link): numbers joined by range, list or tolerance marks, perhaps with units between, ending in a unit; and one link of it."""
    unit = _trie({*KNOWN, *extra})
    inner = rf"{unit}(?![A-Za-zµ°/^\d⁻])"
    end = r"(?![A-Za-zµ°⁻\d])(?!\s?[/^]\s?[A-Za-z\d])(?!\s?[·*]?\s?[A-Za-z]{1,4}\s?(?:\^?[-−]\d|⁻))(?!\s+per\s)"
    chain = re.compile(rf"(?<![\w.,])(?P<v>(?:{_VALUE}(?:{_GAP}?{inner})?(?:{_JOIN}))*?{_VALUE}){_GAP}?(?P<u>{unit}){end}")
    return chain, re.compile(rf"(?P<n>{_VALUE})(?:{_GAP}?(?P<u>{inner}))?(?P<j>{_JOIN})?")


#: A number after one of these is a label, not a quantity.
_LABEL = re.compile(r"(?:\b(?:figs?|figures?|tables?|tab|eqs?|equations?|refs?|no|nos|nr|run|runs|section|sect|sec|ch|chapter|step|sample|pH|version|part|appendix|scheme|p|pp|page|pages)\b\.?|#|\bS)\s*\(?$", re.I)


def number(text: str) -> float:
    """The value of one printed number: grouping by comma, apostrophe or thin space, decimal comma, powers of ten."""
    t = text.strip().translate(_SUP).replace("−", "-")
    m = re.match(rf"([-+]?)({_NUM})(.*)$", t, re.S)
    sign, body, rest = m[1], m[2], m[3]
    body = re.sub(rf"{_GAP}|['’]", "", body)
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", body):
        body = body.replace(",", "")
    else:
        body = body.replace(",", ".")
    e = re.search(r"(?:10\^?\{?|[eE])([-+]?\d+)", rest) if rest.strip() else None
    return float(f"{sign}{body}e{e[1]}" if e else sign + body)


def _unit(text: str | None) -> str | None:
    if not text:
        return None
    return re.sub(_GAP, " ", text)


def mentions(text: str | None, extra: tuple[str, ...] = ()) -> list[tuple[float, float, str, float | None, str | None]]:
    """All stated values of `text`: (lo, hi, unit, second value, second unit).

    A range gives its two ends, a single value twice itself, a tolerance its centre, a list one entry per number; a
    value in two parts (hours and minutes) has the smaller part as second value. Null and empty text give none.
    """
    if not text:
        return []
    text = text.replace("μ", "µ")
    out: list = []
    chain, link = _compiled(extra)
    ended = -1
    for m in chain.finditer(text):
        if _LABEL.search(text[max(0, m.start() - 16) : m.start()]):
            continue
        found = _items([(x["n"], _unit(x["u"]), (x["j"] or "").strip()) for x in link.finditer(m["v"])], _unit(m["u"]))
        between = text[ended : m.start()].strip() if ended >= 0 else None
        if between is not None and len(between) <= 5 and found:
            last, first = out[-1], found[0]
            a, b = KNOWN.get(last[2]), KNOWN.get(first[2])
            plain = last[0] == last[1] and first[0] == first[1] and last[3] is None
            if plain and a and b and a[0] == b[0]:
                if _RANGE.fullmatch(between):  # each end with its own unit
                    x = last[0] if last[2] == first[2] else (last[0] * a[1] + a[2] - b[2]) / b[1]
                    out.pop()
                    found[0] = (min(x, first[0]), max(x, first[0]), first[2], None, None)
                elif between in ("", "and", ",") and a[1] > b[1] and not a[2] and a[0] in ("duration", "mass", "length") and first[0] * b[1] < a[1]:
                    out.pop()  # one value in two parts
                    found[0] = (last[0], last[0], last[2], first[0], first[2])
        out += found
        ended = m.end()
    return out


_RANGE = re.compile(r"-|–|—|−|~|\.\.\.?|…|(?:up\s+)?to")
_PLUS_MINUS = ("±", "+/-", "+-")


def _items(parts: list[tuple[str, str | None, str]], unit: str | None) -> list[tuple]:
    """Read one chain: (number, own unit, mark to the next); numbers without a unit take that of the next."""
    units: list[str | None] = [p[1] for p in parts]
    units[-1] = unit
    for k in range(len(units) - 2, -1, -1):
        units[k] = units[k] or units[k + 1]
    out, k = [], 0
    while k < len(parts):
        x, mark = number(parts[k][0]), parts[k][2]
        if k + 1 < len(parts) and mark in _PLUS_MINUS:
            out.append((x, x, units[k], None, None))
            k += 2
        elif k + 1 < len(parts) and _RANGE.fullmatch(mark):
            y = number(parts[k + 1][0])
            out.append((min(x, y), max(x, y), units[k + 1], None, None))
            k += 2
        else:
            if k + 1 == len(parts) or mark:  # a bare number right before another isn't a quantity
                out.append((x, x, units[k], None, None))
            k += 1
    return out
