"""Canonical JSON of columns: keys sorted, numbers in their shortest form, so that equal payloads have equal hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of c, where c is computed once however often f names it."""
    return F.transform(F.array(c), f)[0]


def _text(c: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes and what is not printable are escaped."""
    short = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def one(ch: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(ch, "UTF-16BE"))), "(.{4})", "\\\\u$1")
        out = F.when(ch.rlike("^[ -~]\\z"), ch).otherwise(units)
        for k, v in short.items():
            out = F.when(ch == k, F.lit(v)).otherwise(out)
        return out

    plain = c.rlike('^[ !#-\\[\\]-~]*\\z')
    escaped = F.array_join(F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), one), "")
    return F.concat(F.lit('"'), F.when(plain, c).otherwise(escaped), F.lit('"'))


def _double(c: Column, whole: bool) -> Column:
    """The shortest digits that give the number again (below 2.3e-308, where doubles hold fewer, 15): positional from 1e-4 to below 1e16, else with an exponent. whole: infinities as strings, no negative zero."""
    some = lambda a, b: F.when(F.length(a) > 0, a).otherwise(b)

    def shortest(x: Column) -> Column:
        forms = [F.format_string(f"%.{n}e", x) for n in (14, 15, 16)]
        return F.coalesce(*[_once(f, lambda s: F.when(s.cast("double") == x, s)) for f in forms[:2]], forms[2])

    def parts(form: Column) -> Column:
        digits = F.rtrim(F.replace(F.substring_index(form, "e", 1), F.lit("."), F.lit("")), F.lit("0"))
        return F.struct(digits.alias("digits"), F.substring_index(form, "e", -1).cast("int").alias("e"))

    def laid_out(p: Column) -> Column:
        digits, e, n = p["digits"], p["e"], F.length(p["digits"])
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        large = F.concat(F.rpad(F.substring(digits, 1, 17), e + 1, "0"), F.lit(".0"))
        split = F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), some(F.substring(digits, e + 2, F.lit(20)), F.lit("0")))
        mantissa = F.when(n > 1, F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, 2, 20))).otherwise(digits)
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), "0"))
        return F.when((e < -4) | (e >= 16), F.concat(mantissa, F.lit("e"), power)).when(e < 0, small).when(n <= e + 1, large).otherwise(split)

    def one(v: Column) -> Column:
        out = _once(_once(shortest(F.abs(v)), parts), laid_out)
        sign = F.when(v < 0, "-").otherwise("")
        zero = F.lit("0.0") if whole else F.when(v.cast("string").startswith("-"), "-0.0").otherwise("0.0")
        endless = F.when(v > 0, '"inf"').otherwise('"-inf"') if whole else F.when(v > 0, "Infinity").otherwise("-Infinity")
        return F.when(F.isnan(v), "null" if whole else "NaN").when(F.abs(v) == float("inf"), endless).when(v == 0, zero).otherwise(F.concat(sign, out))

    return _once(c, one)


def canonical(c: Column, kind: T.DataType, item: str = ",", pair: str = ":", whole: bool = True) -> Column:
    """c as JSON with sorted keys. NaN becomes null, infinities "inf" and "-inf", and -0.0 is 0.0, unless whole is False.

    A struct is an object, or, with fields named _1, _2 and so on, an array of mixed kinds. Dates and times have no JSON form and are refused.
    """
    own = lambda x, t: canonical(x, t, item, pair, whole)
    if isinstance(kind, T.StructType):
        if kind.names and kind.names == [f"_{i + 1}" for i in range(len(kind.names))]:
            inner = F.concat_ws(item, *[own(c[f.name], f.dataType) for f in kind.fields])
            out = F.concat(F.lit("["), inner, F.lit("]"))
        else:
            fields = sorted(kind.fields, key=lambda f: f.name)
            inner = F.concat_ws(item, *[F.concat(_text(F.lit(f.name)), F.lit(pair), own(c[f.name], f.dataType)) for f in fields])
            out = F.concat(F.lit("{"), inner, F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: own(x, kind.elementType)), item), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.array_sort(F.transform(F.map_keys(c), lambda k: F.struct(k.alias("k"), own(F.element_at(c, k), kind.valueType).alias("v"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e["k"]), F.lit(pair), e["v"])), item), F.lit("}"))
    elif isinstance(kind, T.StringType):
        out = _text(c)
    elif isinstance(kind, T.BooleanType):
        out = F.when(c, "true").otherwise("false")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _double(c.cast("double"), whole)
    elif isinstance(kind, T.IntegralType):
        out = c.cast("string")
    elif isinstance(kind, T.NullType):
        out = F.lit(None).cast("string")
    else:
        raise TypeError(f"no canonical JSON for {kind.simpleString()}")
    return F.when(c.isNull(), "null").otherwise(out)


def payload_sha256(c: Column, kind: T.DataType) -> Column:
    """Hash of a payload's canonical JSON."""
    return F.sha2(canonical(c, kind), 256)


def recipe_hash(c: Column, kind: T.DataType) -> Column:
    """Identity of what shapes a search: 16 digits of the hash of its JSON with sorted keys and spaces after commas and colons."""
    return F.substring(F.sha2(canonical(c, kind, ", ", ": ", whole=False), 256), 1, 16)
