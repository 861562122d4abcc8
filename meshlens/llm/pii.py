"""PII: format-preserving Feistel pseudonyms in SQL expressions.

Candidates are found by one regular expression, validated by kind, and
permuted under a key within their format, so that equal values map to equal
pseudonyms wherever they stand and different values never collide:

======  ========================================  ==============================
kind    valid if                                  kept
======  ========================================  ==============================
card    13-19 digits, Luhn sum right              first digit, separators; the check digit is made anew
iban    mod-97 check right (of the longest run    country, length, spaces; check digits are made anew
        of blocks that has it)
ssn     area, group, serial in their ranges       separators; the result is valid again
phone   + and 8-15 digits in all (as many as      country code, punctuation
        the country's plan has, where it's
        fixed), or (ddd) ddd-dddd, which is +1
ip      four octets up to 255                     dotted form (all 32 bits are permuted)
date    a real day from 1700-03-01 to 2100-02-28  order, separators, zero padding; the result is a real day
email   local@domain                              domain, letters stay letters, digits digits
secret  12 or more letters and digits after       the name; hex digits stay hex digits, others
        token/password/... = or :, or a key of    stay letters of their case or digits
        a known form (AKIA, ghp_, sk-, ...)
======  ========================================  ==============================

A Feistel network alternately shifts each half of a value by a keyed SHA-256
stream of the other half (and of kind, format and round); numbers use the
mixed-radix form of it.  Phones are permuted as country code and national
number, so that all spellings of one number stay linked, and so do the two
cases of a hex value.  Text is split at the candidates and joined again:
no Python runs on executors.

Null text stays null; text without candidates is returned as it is, and so are
candidates that fail validation; very long texts go through whole.  Equal
values get equal pseudonyms in repeated rows too.  All rows and all other
columns stay, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"

#: Calling codes of one and two digits (all others have three), and those whose national numbers have one length.
CODES_1, CODES_2 = ("1", "7"), ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
NATIONAL = {8: ("45", "47", "65"), 9: ("31", "33", "34", "41", "48", "61"), 10: ("1", "7", "44", "52", "90", "91"), 11: ("86",)}
_SEP = r"[ ./()-]{0,2}(?:\(0\) ?)?"
_FIXED = "|".join(rf"(?:{'|'.join(codes)})(?:{_SEP}[0-9]){{{n}}}" for n, codes in NATIONAL.items())
_SECRET = r"(?:[0-9a-f]{12,}|[0-9A-F]{12,}|(?=[A-Za-z]{0,64}[0-9])(?=[0-9]{0,64}[A-Za-z])[0-9A-Za-z]{12,})"

#: (what stands before, the candidate, what stands behind) by kind; tried in this order at each place.
PATTERNS = {
    "email": ("", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}", ""),
    "secret": ("", rf"""(?i:token|password|passwd|secret|api[_-]?key)[ \t]{{0,3}}[=:][ \t]{{0,3}}["']?{_SECRET}""", r"(?![0-9A-Za-z])"),
    "key": (r"(?<![0-9A-Za-z])", r"(?:A[KS]IA[0-9A-Z]{16}|gh[opsru]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z]{20,}|xox[abp]-[0-9A-Za-z-]{20,})", r"(?![0-9A-Za-z])"),
    "iban": (r"(?<![0-9A-Za-z])", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", r"(?![0-9A-Za-z])"),
    "phone": (r"(?<![0-9A-Za-z+(])", rf"(?:\+(?:{_FIXED})|\+(?!{'|'.join(c for codes in NATIONAL.values() for c in codes)})[2-9](?:{_SEP}[0-9]){{7,14}}|\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}})", r"(?![0-9])"),
    "date": (r"(?<![0-9.])", r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[.][0-9]{2}[.][0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})", r"(?![0-9]|[.][0-9])"),
    "ip": (r"(?<![0-9.])", r"[0-9]{1,3}(?:[.][0-9]{1,3}){3}", r"(?![0-9]|[.][0-9])"),
    "ssn": (r"(?<![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9-])"),
    "card": (r"(?<![0-9])", r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})", r"(?![0-9])"),
}
CANDIDATE = "|".join(f"(?:{''.join(p)})" for p in PATTERNS.values())


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(key: str, *parts: str) -> str:
    """48 keyed pseudo-random bits as a BIGINT."""
    joined = ", '|', ".join((_text(key), *parts))
    return f"cast(conv(substr(sha2(concat({joined}), 256), 1, 12), 16, 10) as bigint)"


def _shift(value: str, other: str, round_: str, kind: str, key: str, alphabets: tuple[str, ...], within: str) -> str:
    amount = _number(key, _text(kind), within, f"cast({round_} as string)", "cast(j as string)", other)
    c = f"substr({value}, j, 1)"
    whens = " ".join(f"when instr('{a}', {c}) > 0 then substr('{a}', cast((instr('{a}', {c}) - 1 + {amount}) % {len(a)} as int) + 1, 1)" for a in alphabets)
    return f"if(length({value}) = 0, '', array_join(transform(sequence(1, greatest(1, length({value}))), j -> case {whens} else {c} end), ''))"


def _mask(value: str, alphabets: tuple[str, ...]) -> str:
    """The format of a value: which alphabet each character belongs to."""
    for a, mark in zip(alphabets, "9aA"):
        value = f"translate({value}, '{a}', '{mark * len(a)}')"
    return value


def _feistel(value: str, kind: str, key: str, alphabets: tuple[str, ...], within: str = "''") -> str:
    """Permute a string among the strings of its format; ``within``: what selects the permutation beside the kind."""
    # _mask in the stream makes each format a permutation of its own; shifts never change it
    left = _shift("s.a", f"concat({_mask('s.a', alphabets)}, '|', s.b)", "r", kind, key, alphabets, within)
    right = _shift("s.b", f"concat({_mask('s.b', alphabets)}, '|', s.a)", "r", kind, key, alphabets, within)
    start = f"named_struct('a', substr({value}, 1, cast(length({value}) div 2 as int)), 'b', substr({value}, cast(length({value}) div 2 as int) + 1))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(r % 2 = 1, named_struct('a', {left}, 'b', s.b), named_struct('a', s.a, 'b', {right})), s -> concat(s.a, s.b))"


def _mixed(a: str, b: str, m: int, n: int, kind: str, key: str) -> str:
    """Permute pairs (a below m, b below n): a struct of BIGINT a and b."""
    left = f"(s.a + {_number(key, _text(kind), 'cast(r as string)', 'cast(s.b as string)')}) % {m}L"
    right = f"(s.b + {_number(key, _text(kind), 'cast(r as string)', 'cast(s.a as string)')}) % {n}L"
    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(r % 2 = 1, named_struct('a', {left}, 'b', s.b), named_struct('a', s.a, 'b', {right})))"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _refill(template: str, filling: str) -> str:
    """Put the characters of ``filling`` in the places of the template's letters and digits."""
    return (
        f"aggregate(sequence(1, length({template})), named_struct('o', '', 'k', 1), "
        f"(s, i) -> if(substr({template}, i, 1) rlike '[0-9A-Za-z]', named_struct('o', concat(s.o, substr({filling}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, substr({template}, i, 1)), 'k', s.k)), s -> s.o)"
    )


def _luhn(digits: str, doubled_at: int) -> str:
    """Luhn sum of a digit string; ``doubled_at``: parity, from the right, of the doubled places."""
    d = f"cast(substr({digits}, i, 1) as int)"
    twice = f"({d} * 2 - if({d} > 4, 9, 0))"
    return f"aggregate(sequence(1, greatest(1, length({digits}))), 0, (s, i) -> s + if((length({digits}) - i) % 2 = {doubled_at}, {twice}, {d}))"


def _mod97(value: str) -> str:
    """Remainder of an IBAN-like string (letters count 10 to 35) by 97."""
    c = f"substr({value}, i, 1)"
    return f"aggregate(sequence(1, length({value})), 0, (s, i) -> if({c} rlike '[0-9]', s * 10 + cast({c} as int), s * 100 + ascii({c}) - 55) % 97)"


def _card(h: str, key: str) -> str:
    body = "concat(substr(d, 1, 1), " + _feistel("substr(d, 2, length(d) - 2)", "card", key, (DIGITS,)) + ")"
    made = _let(body, "p", f"concat(p, cast((10 - {_luhn('p', 0)} % 10) % 10 as string))")
    return _let(f"translate({h}, ' -', '')", "d", f"if({_luhn('d', 1)} % 10 = 0, {_refill(h, made)}, {h})")


def _iban(h: str, key: str) -> str:
    """The longest run of blocks with a right check is permuted; capitals behind it stay."""
    inner = _feistel("substr(d, 5)", "iban", key, (DIGITS, UPPER))
    check = f"lpad(cast(98 - {_mod97("concat(p, substr(d, 1, 2), '00')")} as string), 2, '0')"
    made = _let(inner, "p", f"concat(substr(d, 1, 2), {check}, p)")
    valid = f"length(e) between 15 and 34 and {_mod97("concat(substr(e, 5), substr(e, 1, 4))")} = 1"
    runs = f"transform(sequence(size(split({h}, ' ')), 1, -1), k -> array_join(slice(split({h}, ' '), 1, k), ' '))"
    right = f"try_element_at(filter({runs}, x -> {_let("replace(x, ' ', '')", 'e', valid)}), 1)"
    done = _let("replace(w, ' ', '')", "d", _refill("w", made))
    return _let(right, "w", f"if(w is null, {h}, concat({done}, substr({h}, length(w) + 1)))")


def _ssn(h: str, key: str) -> str:
    area, group, serial = (f"cast(substr({h}, {a}, {n}) as int)" for a, n in ((1, 3), (5, 2), (8, 4)))
    # areas 001-899 without 666: 898 of them
    index = f"({area} - 1 - if({area} > 666, 1, 0))"
    made = _mixed(f"{index} * 99L + {group} - 1", f"{serial} - 1", 898 * 99, 9999, "ssn", key)
    number = "cast(m.a div 99 + 1 + if(m.a div 99 >= 665, 1, 0) as string)"
    out = _let(made, "m", f"concat(lpad({number}, 3, '0'), '-', lpad(cast(m.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(m.b + 1 as string), 4, '0'))")
    return f"if({area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0, {out}, {h})"


def _phone(h: str, key: str) -> str:
    """The national number is permuted, under its country code; a trunk zero in brackets stays."""
    listed = lambda codes: ", ".join(f"'{c}'" for c in codes)
    length = f"case when left({h}, 1) <> '+' then 0 when substr(d, 1, 1) in ({listed(CODES_1)}) then 1 when substr(d, 1, 2) in ({listed(CODES_2)}) then 2 else 3 end"
    national = _let("substr(d, n + 1)", "v", _feistel("v", "phone", key, (DIGITS,), "if(n = 0, '1', substr(d, 1, n))"))
    filled = _let(f"concat(substr(d, 1, n), {national})", "f", _refill("t", "f"))
    body = _let("regexp_replace(t, '[^0-9]', '')", "d", _let(length, "n", filled))
    return f"replace({_let(f"replace({h}, '(0)', '(_)')", 't', body)}, '(_)', '(0)')"


def _ip(h: str, key: str) -> str:
    octet = [f"cast(o[{i}] as bigint)" for i in range(4)]
    made = _mixed(f"{octet[0]} * 256 + {octet[1]}", f"{octet[2]} * 256 + {octet[3]}", 65536, 65536, "ip", key)
    out = _let(made, "m", "concat_ws('.', cast(m.a div 256 as string), cast(m.a % 256 as string), cast(m.b div 256 as string), cast(m.b % 256 as string))")
    return _let(rf"split({h}, '[.]')", "o", f"if(greatest({', '.join(octet)}) <= 255, {out}, {h})")


def _date(h: str, key: str) -> str:
    """Days are numbered within one Gregorian cycle of 146,097 = 189 x 773 days."""
    cases = []
    for shape, form in (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), ("[.]", "dd.MM.yyyy"), ("^[0-9]{2}/", None)):
        if form is None:  # day first where that is a date, else month first; each reading keeps its numbers apart
            day, month = f"try_to_timestamp({h}, 'dd/MM/yyyy')", f"try_to_timestamp({h}, 'MM/dd/yyyy')"
            inner = f"case when {day} is not null then {_day(h, f'cast({day} as date)', 'dd/MM/yyyy', key)} when {month} is not null then {_day(h, f'cast({month} as date)', 'MM/dd/yyyy', key, 'month-first')} else {h} end"
        else:
            stamp = f"try_to_timestamp({h}, '{form}')"
            inner = f"if({stamp} is not null, {_day(h, f'cast({stamp} as date)', form, key)}, {h})"
        cases.append(f"when {h} rlike '{shape}' then {inner}")
    return f"case {' '.join(cases)} else {h} end"


def _day(h: str, day: str, form: str, key: str, only: str = "") -> str:
    base = "date'1700-03-01'"
    made = _mixed(f"datediff(x, {base}) div 773", f"datediff(x, {base}) % 773", 189, 773, only or "date", key)
    moved = _let(made, "m", f"date_add({base}, cast(m.a * 773 + m.b as int))")
    if only:
        # Month-first text is what has a day above 12: walk the cycle to the next such day.
        moved = f"aggregate(sequence(0, 200), x, (x, k) -> if(k > 0 and day(x) > 12, x, {moved}))"
    return _let(day, "x", f"if(datediff(x, {base}) between 0 and 146096, date_format({moved}, '{form}'), {h})")


def _email(h: str, key: str) -> str:
    return f"concat({_feistel(f"substring_index({h}, '@', 1)", 'email', key, (DIGITS, LOWER, UPPER))}, '@', substring_index({h}, '@', -1))"


def _secret(h: str, key: str) -> str:
    value = f"regexp_extract({h}, '([0-9A-Za-z]+)$', 1)"
    hex_ = _let("lower(v)", "x", _feistel("x", "secret", key, (HEX,)))
    made = f"case when v rlike '^[0-9a-f]+$' then {hex_} when v rlike '^[0-9A-F]+$' then upper({hex_}) else {_feistel('v', 'secret', key, (DIGITS, LOWER, UPPER))} end"
    return _let(value, "v", f"concat(substr({h}, 1, length({h}) - length(v)), {made})")


def _key(h: str, key: str) -> str:
    head = f"regexp_extract({h}, '^(A[KS]IA|gh[opsru]_|sk-|xox[abp]-)', 1)"
    return _let(head, "c", f"concat(c, {_let(f'substr({h}, length(c) + 1)', 'v', _feistel('v', 'key', key, (DIGITS, LOWER, UPPER)))})")


_MAKERS = {"email": _email, "secret": _secret, "key": _key, "iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}


def pseudonym(candidate: str, key: str) -> str:
    """SQL text: the pseudonym of one candidate, or the candidate where it isn't valid."""
    whens = " ".join(f"when {candidate} rlike {_text(f'^(?:{body})$')} then {_MAKERS[kind](candidate, key)}" for kind, (_, body, _) in PATTERNS.items())
    return f"case {whens} else {candidate} end"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with the private values of ``text_col`` replaced, in place.

    ``count_col`` names an optional column for the number of values changed.
    The key belongs to the deployment; who has it can undo the permutation.
    """
    text, mark = F.col(text_col), "_pii"
    while any(c.lower().startswith(mark) for c in (*docs.columns, count_col or "")):
        mark += "_"
    hits, made = f"{mark}_hits", f"{mark}_made"
    cells = docs.withColumn(hits, F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))))
    cells = cells.withColumn(made, F.expr(f"transform({hits}, h -> {pseudonym('h', key)})"))
    parts = F.split(text, CANDIDATE, -1)
    woven: Column = F.concat(F.array_join(F.zip_with(F.slice(parts, F.lit(1), F.size(made)), F.col(made), lambda a, b: F.concat(a, b)), ""), F.element_at(parts, -1))
    out = cells.withColumn(text_col, F.when(F.col(hits).isNull(), text).otherwise(woven))
    if count_col:
        changed = F.expr(f"size(filter(zip_with({hits}, {made}, (a, b) -> a <> b), x -> x))")
        out = out.withColumn(count_col, F.when(F.col(hits).isNull(), 0).otherwise(changed))
    return out.drop(hits, made)
