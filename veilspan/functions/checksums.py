"""Checksums as SQL expressions over a string column or expression."""

from __future__ import annotations

from veilspan.functions.lexicon import IBAN_LENGTHS, TAX_ODD, TAX_ODD_LETTERS

_DIGIT = "cast(substring({s}, {i}, 1) as int)"


def luhn(s: str) -> str:
    """Only digits, at least one, with a right Luhn sum."""
    return f"coalesce(luhn_check({s}), false)"


def iban(s: str) -> str:
    """Known country, its length, its shape, and remainder 1 of the rearranged number modulo 97; no spaces."""
    u = f"upper({s})"
    lengths = "map(" + ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items()) + ")"
    moved = f"concat(substring({u}, 5), substring({u}, 1, 4))"
    # one character at a time: letters bring two digits, so the remainder is shifted by 100
    fold = f"""aggregate(transform(sequence(1, length({moved})), i -> ascii(substring({moved}, i, 1))), 0,
        (r, c) -> if(c < 58, (r * 10 + c - 48) % 97, (r * 100 + c - 55) % 97))"""
    return f"coalesce({u} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$' and length({u}) = {lengths}[substring({u}, 1, 2)] and {fold} = 1, false)"


def vat(s: str) -> str:
    """Eleven digits, the last one the check digit of the others."""
    d = _DIGIT.format(s=s, i="i")
    total = f"aggregate(sequence(1, 10), 0, (a, i) -> a + if(i % 2 = 1, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))"
    return f"coalesce({s} rlike '^[0-9]{{11}}$' and (10 - {total} % 10) % 10 = {_DIGIT.format(s=s, i='11')}, false)"


def tax_code(s: str) -> str:
    """Sixteen characters of the tax code's shape, the last one the check character."""
    u = f"upper({s})"
    c = f"ascii(substring({u}, i, 1))"
    odd_digits, odd_letters = (f"array({', '.join(map(str, v))})" for v in (TAX_ODD, TAX_ODD_LETTERS))
    odd = f"if({c} < 58, {odd_digits}[{c} - 48], {odd_letters}[{c} - 65])"
    even = f"if({c} < 58, {c} - 48, {c} - 65)"
    total = f"aggregate(sequence(1, 15), 0, (a, i) -> a + if(i % 2 = 1, {odd}, {even}))"
    d = "[0-9LMNPQRSTUV]"
    shape = f"^[A-Z]{{6}}{d}{{2}}[ABCDEHLMPRST]{d}{{2}}[A-Z]{d}{{3}}[A-Z]$"
    # the shape comes first: other characters have no value
    return f"case when {u} rlike '{shape}' then 65 + {total} % 26 = ascii(substring({u}, 16, 1)) else false end"
