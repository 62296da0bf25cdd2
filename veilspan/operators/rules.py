"""The rule detectors: prepared documents to arrays of candidates, one array per rule.

A rule has a trigger, a pattern that is cheap where nothing is found, and reads what else it needs
around the trigger afterwards, with checks on the words and numbers found. It looks at the column n
(normalised) or text (original) of `prepare`; the order of RULES is the order in which
equal-ranking candidates win. Everything is evaluated in the JVM. The name rules are in `names`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspan.functions import checksums, lexicon
from veilspan.functions.spans import CANDIDATES, any_of, by_initial, context, find, find_at_starts, sql
from veilspan.operators import names

LETTER_OR_NUMBER = r"[\p{L}\p{N}]"
L, R = rf"(?<!{LETTER_OR_NUMBER})", rf"(?!{LETTER_OR_NUMBER})"  # isolated on the left, on the right


# --- numbers and codes (on n) ------------------------------------------------------------------
# labels of a host as characters without two dots in a row: a repeated group of labels takes a stack frame for each and fails on long ones
EMAIL = r"(?<![\p{L}\p{N}._%+-])[a-z0-9._%+-]+@(?=[a-z0-9-])(?:(?!\.\.)[a-z0-9.-])+\.[a-z]{2,24}" + R
# Digits of cards and separators between them, and the first four digits that issuers have (from, to).
CARD = L + "[0-9](?:[ -]?[0-9]){12,22}" + R
ISSUERS = [(2220, 2720), (3000, 3099), (3400, 3899), (4000, 4999), (5100, 5599), (6011, 6011), (6500, 6599)]
# Groups of digits in telephone numbers (with a country code; of mobile telephones or with an area code).
PHONE_INTERNATIONAL = r"(?<![\p{N}+])\+[0-9]{1,3}[ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}(?!\p{N})"
PHONE_ITALIAN = r"(?<![\p{N}+/])(?:3[0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}|0[0-9]{1,3}(?:[ .-]?[0-9]{2,8}){1,3})(?![\p{N}/])"
VAT = L + r"(?:it ?)?[0-9]{11}(?!\p{N})"
ID_DOCUMENT = L + "[a-z]{2}(?:[0-9]{7}|[0-9]{5}[a-z]{2})" + R
# a run of digits cannot be cut short: what follows a shorter one would be a digit or a dash and a digit
LONG_NUMBER = r"(?<![\p{L}\p{N}.,/])(?<![0-9][ -])[0-9](?:-?[0-9]){7,}+(?![\p{L}\p{N}]|[.,/ -][0-9])"
_GROUPS, _TOKEN = r"[0-9]+(?: [0-9]+){1,5}" + R, r"[a-z0-9][a-z0-9/_-]*[0-9][a-z0-9/_-]*"
CONTEXTUAL = rf"(?<!\p{{L}}){by_initial(lexicon.CONTEXT_ID_KEYWORDS)}(?!\p{{L}})\s*[:#]?\s*({_GROUPS}|{_TOKEN})"
# The parts of a land registry reference, in their order.
CADASTRAL = (
    r"(?<!\p{L})foglio (?:n\. ?)?[0-9]+[a-z]?,? (?:particella|mappale|p\.lla|part\.|mapp\.) (?:n\. ?)?[0-9]+[a-z]?"
    r"(?:,? (?:subalterno|sub\.?) (?:n\. ?)?[0-9]+[a-z]?)?" + R
)
# The places of a tax code; letters may stand for digits (L to V without O), months are A to T.
TAX_CODE = L + r"(?=((?:[a-z] ?){6}(?:[0-9lmnpqrstuv] ?){2}[abcdehlmprst] ?(?:[0-9lmnpqrstuv] ?){2}[a-z] ?(?:[0-9lmnpqrstuv] ?){3}[a-z]" + R + "))"
IBAN_HEAD = L + by_initial([c.lower() for c in lexicon.IBAN_LENGTHS]) + "[0-9]{2}(?= ?[a-z0-9])"
# any dotted host; which of its labels is the top-level domain is looked at afterwards
URL = r"(?<![\p{L}\p{N}@._/-])(?:https?://)?+[a-z0-9-]++(?:\.[a-z0-9-]++)++(?:(?![\p{L}\p{N}@_-])(?::[0-9]{2,5})?(?:[/?#][^\s<>\x22\x27]*)?)?"

# --- plates, addresses, organisations (on text) ------------------------------------------------
PLATE = rf"{L}(?=([A-Z]{{2}}[ -]?[0-9]{{3}}[ -]?[A-Z]{{2}}){R})"
PLATE_KEYWORD = rf"(?<!\p{{L}})(?iu:{by_initial(lexicon.PLATE_KEYWORDS)})(?!\p{{L}})[ \t]*(?:[nN]\.[ \t]*)?:?[ \t]*([A-Z0-9]+(?:[ -][A-Z0-9]+)*+)"

_WORD, _APOSTROPHE = r"[\p{L}'’-]", "['’]"
_STREETS = f"(?:(?iu:{by_initial([w.replace('.', chr(92) + '.') for w in sorted(lexicon.STREET_TYPES + lexicon.STREET_SHORT, key=len, reverse=True)])})|{by_initial(sorted(lexicon.STREET_CAPITALISED, key=len, reverse=True))})"
STREET = rf"(?<![\p{{L}}0-9]){_STREETS}(?=[ \t])"
_ORDINAL = r"(?<![\p{L}0-9])(?:[IVX]{1,4}|[0-9]{1,2}[ªa°º]?)[ \t]+$"
_SMALL = ["dei", "degli", "della", "delle", "del", "dello", "di", "da", "de", "d'", "san", "santa", "santo"]
_STREET_NAME = rf"(?:{any_of(_SMALL)}[ \t]+|[\p{{Lu}}0-9][\p{{L}}'’.0-9-]*"
# A house number with its letter, stair and addition.
_NUMBER = r"(?:nr?\.?\s*)?[0-9]{1,4}(?:[ \t]?[A-Za-z](?!\p{L}))?(?:/[\p{L}0-9]+)?(?:[ \t](?:bis|ter|quater)(?!\p{L}))?"
_GAP = r"(?:[ \t]*[,\-–][ \t]*|[ \t]+)"
_CITY = rf"\p{{Lu}}{_WORD}+(?:[ \t]+(?:(?:di|del|della|sul|in)[ \t]+)?\p{{Lu}}{_WORD}+){{0,2}}"
STREET_TAIL = rf"^[ \t]+(?:{_STREET_NAME}[ \t]+)){{0,6}}?(?:{_STREET_NAME})),?[ \t]*{_NUMBER}(?:{_GAP}[0-9]{{5}})?(?:{_GAP}{_CITY}(?:[ \t]+\(\p{{Lu}}{{2}}\))?)?"
ADDRESS_ENGLISH = rf"{L}[0-9]{{1,5}}[ \t]+(?:\p{{Lu}}[\p{{L}}'’.-]*[ \t]+){{1,4}}{any_of(lexicon.STREET_SUFFIXES, False)}"
BY_MEANS = rf"(?iu)^via[ \t]+{any_of(lexicon.BY_MEANS_OF, False)}(?!\p{{L}})"

_DOTTED_FORM = "(?iu:" + by_initial([f[:-1].replace(".", r"\.") for f in lexicon.DOTTED_FORMS]) + r")\.?"
_PLAIN_FORM = by_initial([f.replace(".", r"\.") for f in lexicon.PLAIN_FORMS])
_FORM = f"(?:{_DOTTED_FORM}|{_PLAIN_FORM})"
LEGAL_FORM = rf"(?<=[ \t]){_FORM}" + R
_LINK = rf"(?:(?:(?iu:{'|'.join(lexicon.LINKS)})|&)[ \t]+|(?iu:{'|'.join(lexicon.ELIDED_LINKS)}){_APOSTROPHE})"
_FIRM_WORD = rf"(?!{_FORM}{R})[\p{{Lu}}0-9][\p{{L}}\p{{N}}'’&.-]*"
FIRM = rf"(?<![\p{{L}}\p{{N}}.]){_FIRM_WORD}(?:[ \t]+{_LINK}?{_FIRM_WORD}){{0,3}}[ \t]*,?[ \t]+$"
_PROPER = rf"\p{{Lu}}{_WORD}*"
INSTITUTION = L + by_initial([form for head in lexicon.INSTITUTION_HEADS for form in (head, head.upper())]) + r"(?=[ \t])"
INSTITUTION_TAIL = rf"^((?:[ \t]+{_PROPER}){{0,3}}(?:[ \t]+{_LINK}{_PROPER}(?:[ \t]+{_PROPER})?){{0,2}}){R}"


@dataclass(frozen=True)
class Rule:
    """Matches of a trigger, each with a span and a confidence in SQL over the match x (null: dropped).

    x has start, end, value and grp: the group's text, or what `reads` (SQL over x) finds around
    the trigger (the group is then called group); if that is empty, the match is dropped. Spans are relative to the text matched on, and
    those of triggers that may overlap are taken from left to right.
    """

    name: str
    category: str
    trigger: str
    on: str = "n"
    group: int = 0
    level: str = "'high'"
    start: str = "x.start"
    end: str = "x.end"
    reads: str = ""
    at_starts: bool = False
    needs: tuple[str, ...] = ()  # one of these is in every text with a match
    digits: bool = True  # so is a digit

    def found(self) -> Column:
        """The matches of the trigger."""
        text = F.col(self.on)
        gate = F.lit(not self.needs)
        for word in self.needs:
            gate = gate | text.contains(word)
        if self.digits:
            gate = gate & text.rlike("[0-9]")
        return find_at_starts(text, self.trigger, gate) if self.at_starts else find(text, self.trigger, self.group, gate)

    def read(self, m: str) -> Column:
        """The matches in the column m with what is read around them."""
        return F.expr(f"filter(transform({m}, x -> struct(x.start, x.end, x.value, {self.reads} as grp, x.grp as group)), x -> x.grp <> '')") if self.reads else F.col(m)

    def judged(self, m: str) -> Column:
        """The matches in the column m as candidates."""
        graded = f"filter(transform({m}, x -> struct({self.start} as s, {self.end} as e, {self.level} as level)), y -> y.level is not null and y.s is not null and y.e > y.s)"
        if self.reads or self.at_starts:
            graded = f"aggregate({graded}, struct(0 as at, cast(array() as array<struct<s:int,e:int,level:string>>) as out), (a, y) -> if(y.s >= a.at, struct(y.e as at, array_append(a.out, y) as out), a)).out"
        return F.expr(f"if(size({m}) = 0, cast(array() as {CANDIDATES}), {self._candidates(graded)})")

    def _candidates(self, spans: str) -> str:
        first, last = ("if(starts is null, y.s, element_at(starts, y.s + 1))", "if(ends is null, y.e, element_at(ends, y.e))") if self.on == "n" else ("y.s", "y.e")
        return f"""transform({spans}, y -> struct(cast({first} as int) as start, cast({last} as int) as end, '{self.category}' as category,
            y.level as confidence, 'rule' as method, '{self.name}' as rule))"""


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


_PLAUSIBLE = f"length({_digits('x.value')}) between 8 and 15"
_VAT_NUMBER = "regexp_replace(x.value, '^it ?', '')"
_LENGTHS = "map(" + ", ".join(f"'{c.lower()}', {n}" for c, n in lexicon.IBAN_LENGTHS.items()) + ")"
# as many letters and digits as the country has, with single spaces, and none after them
_IBAN_READS = f"regexp_extract(substring(n, x.start + 1, 80), concat('^[a-z]{{2}}[0-9]{{2}}(?: ?[a-z0-9]){{', {_LENGTHS}[substring(x.value, 1, 2)] - 4, '}}(?![a-z0-9])'), 0)"
_IBAN = "replace(x.grp, ' ', '')"
_IBAN_LEVEL = f"""case when {checksums.iban(_IBAN)} then 'high'
    when startswith(x.grp, 'it') and not {_IBAN} rlike {sql("^it[0-9]{2}[a-z][0-9]{10}[a-z0-9]{12}$")} then null
    when {context("n", "x.start", lexicon.IBAN_KEYWORDS, 40)} then 'high' else 'medium' end"""
_ISSUED = "(" + " or ".join(f"cast(substring({_digits('x.value')}, 1, 4) as int) between {a} and {b}" for a, b in ISSUERS) + ")"
# the number of digits that are the card's: all after a keyword, else the longest valid prefix
_CARD_DIGITS = f"""if(length({_digits("x.value")}) between 13 and 19 and {context("n", "x.start", lexicon.CARD_KEYWORDS, 30)}, length({_digits("x.value")}),
    get(filter(sequence(19, 13, -1), k -> k <= length({_digits("x.value")}) and {_ISSUED}
        and {checksums.luhn(f"substring({_digits('x.value')}, 1, k)")}), 0))"""
_CARD_END = f"""x.start + transform(array({_CARD_DIGITS}), m -> get(filter(sequence(1, length(x.value)), i -> length({_digits("substring(x.value, 1, i)")}) = m), 0))[0]"""
_VAT_LEVEL = f"""case when if({checksums.vat(_VAT_NUMBER)}, {context("n", "x.start", lexicon.VAT_KEYWORDS, 40)},
    {context("n", "x.start", lexicon.VAT_KEYWORDS, 16)}) then 'high' end"""
_TAX_VALUE = "replace(x.value, ' ', '')"
_TAX_LEVEL = f"""case when {checksums.tax_code(_TAX_VALUE)} then 'high' when contains(x.value, ' ') then null
    when {context("n", "x.start", lexicon.TAX_CODE_KEYWORDS, 24)} then 'high' else 'medium' end"""

# the longest run of leading groups with the right sizes, isolated, in the shape of a plate
_PLATE_READS = f"""coalesce(get(transform(filter(transform(sequence(least(size(split(x.grp, '[ -]')), 3), 1, -1), k -> struct(k as k, split(x.grp, '[ -]') as g,
    regexp_extract(x.grp, concat('^[A-Z0-9]+(?:[ -][A-Z0-9]+){{', k - 1, '}}'), 0) as v)),
    c -> length(c.g[0]) <= 7 and forall(slice(c.g, 2, c.k - 1), w -> length(w) <= 6) and (c.k < size(c.g) or not substring(text, x.end + 1, 1) rlike {sql(LETTER_OR_NUMBER)})
      and length(regexp_replace(c.v, '[ -]', '')) between 5 and 9 and c.v rlike '[A-Z]' and c.v rlike '[0-9]'), c -> c.v), 0), '')"""

# which labels of a host are the domain: with scheme or www any top-level domain, else a known one; the longest that ends well
_SCHEME = "regexp_extract(x.value, '^https?://', 0)"
_HOST = f"regexp_extract(substring(x.value, length({_SCHEME}) + 1), '^[a-z0-9.-]+[a-z0-9-]', 0)"
_BARE = ", ".join(f"'{t}'" for t in lexicon.BARE_TLDS)
_URL_READS = f"""coalesce(transform(array(struct({_SCHEME} as scheme, split({_HOST}, '[.]') as g, substring(x.value, length({_SCHEME}) + length({_HOST}) + 1) as tail)),
    h -> transform(array(filter(sequence(size(h.g), 2, -1), k -> k < size(h.g) or h.tail <> '' or not substring(n, x.end + 1, 1) rlike {sql(r"[\p{L}\p{N}@_-]")})),
      ks -> transform(array(coalesce(get(filter(ks, k -> h.g[k - 1] rlike '^[a-z]{{2,24}}$' and (h.scheme <> '' or (h.g[0] = 'www' and k > 2))), 0),
          get(filter(ks, k -> h.scheme = '' and h.g[k - 1] in ({_BARE})), 0))),
        k -> concat(h.scheme, array_join(slice(h.g, 1, k), '.'), if(k = size(h.g), h.tail, '')))[0])[0])[0], '')"""
_URL_VALUE = "regexp_replace(x.grp, '[.,;:!?)\\\\]]+$', '')"
_URL_SEEN = f"substring(text, if(starts is null, x.start, element_at(starts, x.start + 1)) + 1, length({_URL_VALUE}))"
_URL_LEVEL = f"""case when {_URL_SEEN} rlike '(?i)^(?:https?://|www[.])' or not {_URL_SEEN} rlike {sql(r"^[^/?#:]*[.]\p{Lu}\p{Ll}+(?=$|[/?#:])")} then 'high' end"""

REACH = 400  # characters around a trigger that a rule reads
_LINE_BEFORE = f"substring_index(substring(text, greatest(x.start - {REACH}, 0) + 1, least({REACH}, x.start)), '\\n', -1)"
_AFTER = f"substring(text, x.end + 1, {REACH})"
_STREET_START = f"x.start - length(regexp_extract(substring(text, greatest(x.start - 40, 0) + 1, least(40, x.start)), {sql(_ORDINAL)}, 0))"
_TAIL_WORDS = f"split(x.grp, {sql('[ \\t' + chr(39) + '’]+')})"
_LABELS = ", ".join(f"'{w}'" for w in lexicon.FORM_LABELS)
_PROPER_TAIL = f"exists({_TAIL_WORDS}, w -> w rlike {sql('^\\p{Lu}')}) and not exists({_TAIL_WORDS}, w -> w rlike {sql('^\\p{Lu}')} and lower(w) in ({_LABELS}))"

_RULES = {
    r.name: r
    for r in (
        Rule("email", "EMAIL", EMAIL, needs=("@",), digits=False),
        Rule("iban", "IBAN", IBAN_HEAD, reads=_IBAN_READS, level=_IBAN_LEVEL, end="x.start + length(x.grp)"),
        Rule("payment-card", "PAYMENT_CARD", CARD, end=_CARD_END),
        Rule("phone-international", "PHONE", PHONE_INTERNATIONAL, level=f"if({_PLAUSIBLE}, 'high', null)", needs=("+",)),
        Rule("phone-italian", "PHONE", PHONE_ITALIAN, level=f"if({_PLAUSIBLE} and {context('n', 'x.start', lexicon.PHONE_KEYWORDS, 40)}, 'high', null)", needs=("tel", "cell", "phone", "mobile", "fax")),
        Rule("it-tax-code", "IT_TAX_CODE", TAX_CODE, at_starts=True, level=_TAX_LEVEL, digits=False),
        Rule("it-vat", "IT_VAT", VAT, level=_VAT_LEVEL, needs=("iva", "vat")),
        Rule("id-document", "ID_DOCUMENT", ID_DOCUMENT, level=f"if({context('n', 'x.start', lexicon.ID_DOCUMENT_KEYWORDS, 50)}, 'high', null)"),
        Rule("contextual-id", "CONTEXTUAL_ID", CONTEXTUAL, group=1, start="x.end - length(x.grp)", level=f"if(length({_digits('x.grp')}) <= 20, 'high', null)"),
        Rule("long-number", "CONTEXTUAL_ID", LONG_NUMBER, level=f"if(length({_digits('x.value')}) <= 16, 'high', null)"),
        Rule("address-italian", "LOCATION", STREET, on="text", reads=f"regexp_extract({_AFTER}, {sql(STREET_TAIL)}, 0)", start=_STREET_START, end="x.end + length(rtrim(x.grp))",
             level=f"if(concat(substring(text, {_STREET_START} + 1, x.end - ({_STREET_START})), x.grp) rlike {sql(BY_MEANS)}, null, 'high')"),
        Rule("address-english", "LOCATION", ADDRESS_ENGLISH, on="text"),
        Rule("url", "URL", URL, needs=(".",), digits=False, reads=_URL_READS, end=f"x.start + length({_URL_VALUE})", level=_URL_LEVEL),
        Rule("plate-announced", "VEHICLE_PLATE", PLATE_KEYWORD, on="text", group=1, reads=_PLATE_READS,
             start="x.end - length(x.group)", end="x.end - length(x.group) + length(x.grp)"),
        Rule("plate", "VEHICLE_PLATE", PLATE, on="text", at_starts=True, level="if(x.value rlike '[IOQU]', null, 'high')"),
        Rule("company", "ORGANIZATION", LEGAL_FORM, on="text", digits=False, reads=f"regexp_extract({_LINE_BEFORE}, {sql(FIRM)}, 0)", start="x.start - length(x.grp)"),
        Rule("institution", "ORGANIZATION", INSTITUTION, on="text", digits=False, reads=f"regexp_extract({_AFTER}, {sql(INSTITUTION_TAIL)}, 1)", end="x.end + length(x.grp)",
             level=f"if({_PROPER_TAIL}, 'high', null)"),
        Rule("cadastral-reference", "CONTEXTUAL_ID", CADASTRAL, needs=("foglio",)),
    )
}


def _plates(announced: Column, current: Column) -> Column:
    new = F.filter(current, lambda x: ~F.exists(announced, lambda y: y["start"] == x["start"]))
    return names.by_start(F.concat(announced, new))


# rules made of two: their parts, and how the candidates are combined
_PAIRS = {
    "phone": ("phone-international", "phone-italian", lambda a, b: names.by_start(F.concat(a, b))),
    "vehicle-plate": ("plate-announced", "plate", _plates),
    "address": ("address-italian", "address-english", F.concat),
    "organization": ("company", "institution", F.concat),  # merged afterwards
}


# The order is a tie-break of the resolution.
RULES = [
    "email", "iban", "payment-card", "phone", "it-tax-code", "it-vat", "id-document", "contextual-id", "long-number", "address", "labeled-field",
    "titled-name", "first-name-pair", "url", "vehicle-plate", "organization", "cadastral-reference",
]


def detect(prepared: DataFrame, rules: list[str] | None = None, out: str = "candidates", first_names: list[str] | DataFrame | None = None) -> DataFrame:
    """A prepared table with the candidates of all rules, in the order of the rules, in one array column.

    All triggers are one step, then all that is read around them, then the judgements, so that the
    plan has few steps however many rules there are.
    """
    from veilspan.operators.resolve import merged

    rules = RULES if rules is None else rules
    parts = [p for r in rules for p in (_PAIRS[r][:2] if r in _PAIRS else () if r in names.RULES else (r,))]
    named = {f"_{r}": names.column(r, first_names) for r in rules if r in names.RULES}
    d = prepared.withColumns({f"_{p}": _RULES[p].found() for p in parts} | named)
    reading = {f"_{p}": _RULES[p].read(f"`_{p}`") for p in parts if _RULES[p].reads}
    d = d.withColumns(reading) if reading else d
    d = d.withColumns({f"_{p}": _RULES[p].judged(f"`_{p}`") for p in parts}) if parts else d
    pairs = {f"_{r}": _PAIRS[r][2](F.col(f"`_{_PAIRS[r][0]}`"), F.col(f"`_{_PAIRS[r][1]}`")) for r in rules if r in _PAIRS}
    d = d.withColumns(pairs) if pairs else d
    own = [merged(F.col("_organization")) if r == "organization" else F.col(f"`_{r}`") for r in rules]
    return d.withColumn(out, F.concat(*own)).select(*[F.col(c) for c in prepared.columns], out)


def apply(df: DataFrame, rule: str, out: str, first_names: list[str] | DataFrame | None = None) -> DataFrame:
    """A prepared table with the candidates of one rule in the column `out`."""
    return detect(df, [rule], out, first_names)
