"""Exact decimals of any length as SQL expressions.

A number is ``struct<f int, l array<bigint>>``: limbs of six digits, least
significant first, each with the number's sign; the first ``f`` limbs are the
fraction.  Sums and products work limb by limb and carry only when a result is
read, so nothing overflows below 2^40 lines or nine thousand limbs.

Every function takes and gives SQL text, so a whole formula is one ``F.expr``.
They are higher-order functions, evaluated row by row; the rules use them only
for values that no Spark decimal holds (``money.decimal_of`` is null).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from itertools import count

DIGITS = 6
BASE = 10**DIGITS
_NAMES = count()


def _name() -> str:
    return f"v{next(_NAMES)}"


def _let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is computed once."""
    v = _name()
    return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"


def _map(values: str, body: Callable[[str], str]) -> str:
    v = _name()
    return f"transform({values}, {v} -> {body(v)})"


def _zeros(n: str) -> str:
    return f"array_repeat(0L, {n})"


def _make(f: str, limbs: str) -> str:
    return f"named_struct('f', int({f}), 'l', {limbs})"


def scale(text: str) -> str:
    """Number of fraction digits of a plain decimal text."""
    return f"if(instr({text}, '.') > 0, length({text}) - instr({text}, '.'), 0)"


def number(text: str) -> str:
    """Number of a plain decimal text."""

    def cut(t: str, digits: str) -> str:
        n = f"int(length({digits}) div {DIGITS})"
        sign = f"if(startswith({t}, '-'), -1L, 1L)"
        return _map(f"sequence(1, {n})", lambda i: f"bigint(substring({digits}, ({n} - {i}) * {DIGITS} + 1, {DIGITS})) * {sign}")

    def of_parts(t: str) -> str:
        body = f"ltrim('-', {t})"
        whole, part = f"substring_index({body}, '.', 1)", f"if(instr({t}, '.') > 0, substring_index({t}, '.', -1), '')"
        padded = lambda p, side: f"{side}({p}, int(ceil(length({p}) / {DIGITS})) * {DIGITS}, '0')"
        limbs = _let(f"{padded(whole, 'lpad')} || {padded(part, 'rpad')}", lambda digits: cut(t, digits))
        return _make(f"ceil(length({part}) / {DIGITS})", limbs)

    return _let(text, of_parts)


def minus(x: str) -> str:
    return _let(x, lambda v: _make(f"{v}.f", _map(f"{v}.l", lambda a: f"-{a}")))


def plus(*terms: str) -> str:
    """Sum of numbers."""

    def aligned(every: str, f: str) -> str:
        total, t, a, b = _name(), _name(), _name(), _name()
        add = f"zip_with({total}, concat({_zeros(f'{f} - {t}.f')}, {t}.l), ({a}, {b}) -> coalesce({a}, 0L) + coalesce({b}, 0L))"
        return _make(f, f"aggregate({every}, cast(array() as array<bigint>), ({total}, {t}) -> {add})")

    return _let(f"array({', '.join(terms)})", lambda every: _let(f"array_max({_map(every, lambda t: f'{t}.f')})", lambda f: aligned(every, f)))


def times(x: str, y: str) -> str:
    """Product of two numbers, each with limbs below ``BASE``."""

    def product(p: str) -> str:
        n, m = f"size({p}.x.l)", f"size({p}.y.l)"

        def place(k: str) -> str:
            s, i = _name(), _name()
            return f"aggregate(sequence(greatest(0, {k} - {m} + 1), least({k}, {n} - 1)), 0L, ({s}, {i}) -> {s} + {p}.x.l[{i}] * {p}.y.l[{k} - {i}])"

        return _make(f"{p}.x.f + {p}.y.f", _map(f"sequence(0, {n} + {m} - 2)", place))

    return _let(f"named_struct('x', {x}, 'y', {y})", product)


def _carried(limbs: str) -> str:
    """struct(c, out): limbs in 0 to BASE - 1 and the carry above them."""
    s, v = _name(), _name()
    digit = f"pmod({s}.c + {v}, {BASE}L)"
    step = f"named_struct('c', ({s}.c + {v} - {digit}) div {BASE}L, 'out', concat({s}.out, array({digit})))"
    return f"aggregate(concat({limbs}, {_zeros('4')}), named_struct('c', 0L, 'out', cast(array() as array<bigint>)), ({s}, {v}) -> {step})"


def size(x: str) -> str:
    """struct(negative, f, l): the sign, and limbs of the absolute value in 0 to BASE - 1."""

    def signed(x: str, first: str) -> str:
        other = _carried(_map(f"{x}.l", lambda v: f"-{v}"))
        return f"named_struct('negative', {first}.c < 0, 'f', {x}.f, 'l', if({first}.c < 0, {other}.out, {first}.out))"

    return _let(x, lambda x: _let(_carried(f"{x}.l"), lambda first: signed(x, first)))


def exceeds(x: str, bound: Decimal) -> str:
    """|x| > bound, for a bound of 0 or more."""

    def above(s: str) -> str:
        v = _name()
        gap = size(plus(_make(f"{s}.f", f"{s}.l"), minus(number(f"'{bound:f}'"))))
        return _let(gap, lambda d: f"not {d}.negative and exists({d}.l, {v} -> {v} <> 0)")

    return _let(size(x), above)


def _digits(x: str, body: Callable[[str, str, str], str]) -> str:
    """``body`` of (negative, whole digits, fraction digits)."""

    def cut(s: str, text: str) -> str:
        at = f"length({text}) - {s}.f * {DIGITS}"
        whole, part = f"ltrim('0', substring({text}, 1, {at}))", f"substring({text}, {at} + 1, {s}.f * {DIGITS})"
        parts = f"named_struct('whole', if({whole} = '', '0', {whole}), 'part', {part})"
        return _let(parts, lambda p: body(f"{s}.negative", f"{p}.whole", f"{p}.part"))

    def joined(s: str) -> str:
        return f"array_join({_map(f'reverse({s}.l)', lambda v: f'lpad(string({v}), {DIGITS}, {chr(39)}0{chr(39)})')}, '')"

    return _let(size(x), lambda s: _let(joined(s), lambda text: cut(s, text)))


def plain_text(x: str) -> str:
    """Plain decimal text without closing zeros of the fraction."""

    def build(negative: str, whole: str, part: str) -> str:
        return f"concat(if({negative}, '-', ''), {whole}, if(rtrim('0', {part}) = '', '', concat('.', rtrim('0', {part}))))"

    return _digits(x, build)


def decimal_text(x: str, scale: str) -> str:
    """``str`` of a Python decimal of this value with exponent ``-scale``; the value has no more fraction digits."""

    def build(negative: str, whole: str, part: str) -> str:
        def shown(p: str) -> str:
            sign = f"if({p}.negative, '-', '')"
            left = f"length({p}.digits) - {p}.scale"  # digits before the point
            fixed = f"concat({sign}, {p}.whole, if({p}.scale > 0, '.' || {p}.part, ''))"
            exponent = f"concat({sign}, left({p}.digits, 1), if(length({p}.digits) > 1, '.' || substring({p}.digits, 2), ''), 'E', string({left} - 1))"
            return f"if({left} > -6, {fixed}, {exponent})"

        def filled(p: str) -> str:
            digits = f"ltrim('0', {p}.whole || {p}.part)"
            return f"named_struct('negative', {p}.negative, 'whole', {p}.whole, 'part', {p}.part, 'scale', {p}.scale, 'digits', if({digits} = '', '0', {digits}))"

        part = f"substring({part} || repeat('0', {scale}), 1, {scale})"
        given = f"named_struct('negative', {negative}, 'whole', {whole}, 'part', {part}, 'scale', {scale})"
        return _let(given, lambda p: _let(filled(p), shown))

    return _digits(x, build)


def places(text: str) -> str:
    """array<struct<place int, limb bigint>> of a plain decimal text; place 0 holds the units, place -1 the first six digits of the fraction."""
    v, i = _name(), _name()
    return _let(number(text), lambda x: f"transform({x}.l, ({v}, {i}) -> named_struct('place', {i} - {x}.f, 'limb', {v}))")


def of_places(sums: str) -> str:
    """Number of an array of (place, limb), sorted by place and each place once."""

    def spread(s: str, by_place: str) -> str:
        low, high = f"least(0, {s}[0].place)", f"greatest(0, element_at({s}, -1).place)"
        return _make(f"-{low}", _map(f"sequence({low}, {high})", lambda p: f"coalesce(try_element_at({by_place}, {p}), 0L)"))

    return _let(sums, lambda s: _let(f"map_from_entries({s})", lambda by_place: spread(s, by_place)))
