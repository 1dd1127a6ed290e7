"""Text forms of values, and string helpers whose rules differ from Spark's own.

Numbers of entities are doubles. Their display form has the fewest digits that read back the same, with an exponent
below 1e-4 and from 1e6 on; a cell's form is plain for whole numbers.
"""

from __future__ import annotations

import json
import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space to regular expressions of the RE2 family: no vertical tab.
RE2_SPACE = r"[\t\n\f\r ]"
#: Edges of ASCII words, whatever engine reads the pattern.
EDGE_BEFORE, EDGE_AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


# --- Python forms, for values out of JSON ----------------------------------------------------------------------


def _digits(x: float) -> tuple[str, str, int]:
    """Sign, shortest digits and decimal exponent of a finite number."""
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).lstrip("0")
    whole = text.rstrip("0")
    return ("-" if sign else ""), whole or "0", (len(text) + exponent - 1 if whole else 0)


def _placed(sign: str, digits: str, e: int) -> str:
    """Plain decimal form."""
    if e < 0:
        return f"{sign}0.{'0' * (-e - 1)}{digits}"
    if len(digits) <= e + 1:
        return sign + digits + "0" * (e + 1 - len(digits))
    return f"{sign}{digits[: e + 1]}.{digits[e + 1 :]}"


def _scientific(sign: str, digits: str, e: int) -> str:
    rest = f".{digits[1:]}" if len(digits) > 1 else ""
    return f"{sign}{digits[0]}{rest}e{'-' if e < 0 else '+'}{abs(e):02d}"


def number_text(x: float) -> str:
    """The display form of a number."""
    if math.isnan(x):
        return "NaN"
    if math.isinf(x):
        return "+Inf" if x > 0 else "-Inf"
    parts = _digits(x)
    return _scientific(*parts) if parts[2] < -4 or parts[2] >= 6 else _placed(*parts)


def value_text(v) -> str:
    """The display form of any JSON value: <nil>, [a b], map[k:v]."""
    if v is None:
        return "<nil>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(float(v))
    if isinstance(v, list):
        return "[" + " ".join(map(value_text, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{value_text(v[k])}" for k in sorted(v)) + "]"
    return v


_ESCAPES = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", chr(0x2028): "\\u2028", chr(0x2029): "\\u2029"})


def canonical(v) -> str:
    """JSON with sorted keys and no white space: equal values have equal texts."""
    if v is None or isinstance(v, bool):
        return json.dumps(v)
    if isinstance(v, (int, float)):
        x = float(v)
        if not math.isfinite(x):
            return "null"
        sign, digits, e = _digits(x)
        if x and (e < -6 or e >= 21):
            text = _scientific(sign, digits, e)
            return text.replace("e-0", "e-") if "e-0" in text else text
        return _placed(sign, digits, e)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False).translate(_ESCAPES)
    if isinstance(v, list):
        return "[" + ",".join(map(canonical, v)) + "]"
    return "{" + ",".join(f"{canonical(k)}:{canonical(v[k])}" for k in sorted(v)) + "}"


def cell_text(v) -> str:
    """The form of a value in a table's cell."""
    if v is None:
        return ""
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        x = float(v)
        return str(int(x)) if math.isfinite(x) and x == int(x) and abs(x) < 2**63 else number_text(x)
    return canonical(v)


# --- columns ---------------------------------------------------------------------------------------------------


def let(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f mentions it and wherever: also inside f's own lambdas, where a column would be
    evaluated anew for each element."""
    return F.get(F.transform(F.array(c), f), 0)


def number_str(x: Column) -> Column:
    """number_text() of a numeric column."""
    x = x.cast("double")
    raw = F.abs(x).cast("string")
    mantissa, power = F.substring_index(raw, "E", 1), F.coalesce(F.regexp_extract(raw, r"E\+?(-?\d+)$", 1).try_cast("int"), F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    run = F.concat(whole, part)
    text = F.regexp_replace(run, "^0+", "")
    digits = F.regexp_replace(text, "0+$", "")
    e = F.length(whole) + power - (F.length(run) - F.length(text)) - 1
    sign = F.when(x < 0, "-").otherwise("")
    zeros = lambda n: F.repeat(F.lit("0"), n)
    point = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""))
    scientific = F.concat(sign, point, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), 2, "0"))
    small = F.concat(sign, F.lit("0."), zeros(-e - 1), digits)
    large = F.concat(sign, digits, zeros(e + 1 - F.length(digits)))
    mixed = F.concat(sign, F.substr(digits, F.lit(1), e + 1), F.lit("."), F.substr(digits, e + 2))
    return (
        F.when(F.isnan(x), "NaN").when(x == math.inf, "+Inf").when(x == -math.inf, "-Inf").when(x == 0, "0")
        .when((e < -4) | (e >= 6), scientific).when(e < 0, small).when(F.length(digits) <= e + 1, large).otherwise(mixed)
    )


def go_str(c: Column, kind: str) -> Column:
    """value_text() of a column of a simple type (a Spark type name); null is <nil>."""
    if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal"):
        c = number_str(c)
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit("<nil>"))


def cell_str(c: Column, kind: str) -> Column:
    """cell_text() of a column of a simple type."""
    if kind in ("double", "float"):
        c = F.when((c == F.floor(c)) & (F.abs(c) < 2**63), c.cast("decimal(20,0)").cast("string")).otherwise(number_str(c))
    elif kind.startswith(("array", "struct", "map")):
        c = F.to_json(c)
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


#: Every character with the White_Space property.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_u(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def fields(c: Column) -> Column:
    """The words between white space of any kind."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(fields(c))


def slug(c: Column) -> Column:
    """Lower-case letters and digits; spaces, dashes and underscores as single dashes; nothing else."""
    kept = F.regexp_replace(F.lower(trim_u(c)), "[^a-z0-9 _-]", "")
    return F.regexp_replace(F.regexp_replace(kept, "[ _-]+", "-"), "^-|-$", "")
