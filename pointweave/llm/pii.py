"""Format-preserving Feistel pseudonyms for personal data in texts, in DataFrame functions only.

A value that looks like a card number, IBAN, social security number, phone number, IPv4 address or date is validated
(check digits, ranges, calendar). The kinds are searched one after the other, and what fails is searched again for the
kinds that follow. Groups of digits or capitals that stand side by side are one run, in which a card or IBAN may begin
and end at every group, so neighbours such as an order number, expiry or currency do not hide it. A valid value is mapped by a keyed Feistel permutation of its format's domain and
written back in the same layout, with check digits computed anew. Equal values get equal pseudonyms wherever they occur
and different values different ones, without any table, so documents stay linked and no row moves between tasks. Dates are
those of the years 0001 to 9999. Phone numbers are of the layout 3-3-4 with or without a country code; others stay.
E-mail addresses are no numbers; their pseudonym is a keyed digest.

The round function is SHA-256 over the key, the format, the domain, the round and one half.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_name

ROUNDS = 10
KINDS = ("email", "iban", "date", "ssn", "ip", "phone", "card")
#: Dates are permuted among all days of the years 0001 to 9999, which are 2127 * 1717.
FIRST_DAY, DAY_HALVES = "0001-01-01", (2127, 1717)
#: Steps after which a walk among the days past the 12th, three in five of all, has ended for certain but for 1 in 10 ** 25.
WALK = 64

#: Length of an IBAN per country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}

_BOUND = r"(?<![A-Za-z0-9_])"
_END = r"(?![A-Za-z0-9])"
_ANY_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_COUNTRY_IBAN = "(?:" + "|".join(
    f"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + f"(?: ?[A-Z0-9]{{{n % 4}}})" * (n % 4 > 0) + _END
    for n, names in IBAN_LENGTHS.items()) + ")"
#: Layouts of cards as printed; others are tried after these.
_PRINTED_CARD = r"(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{13,19})" + _END
CARD_DIGITS = range(19, 12, -1)

PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "date": _BOUND + r"(?<![/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-SU-Za-z]|T[A-Za-z])",
    "ssn": _BOUND + r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": _BOUND + r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9A-Za-z])",
    "phone": r"(?<![A-Za-z0-9_+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
}
_FIXED = ("date", "ssn", "ip", "phone")
_ANY_FIXED = "|".join(f"(?:{PATTERNS[k]})" for k in _FIXED)
#: Runs of groups, however long; possessive, so that the search neither recurses nor goes back.
IBAN_RUN = _BOUND + r"(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4})[A-Z0-9]++(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+"
CARD_RUN = _BOUND + r"(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+"
#: A run that begins as a value of another kind is not taken for a card as a whole.
WHOLE_CARD = f"(?!{_ANY_FIXED})" + CARD_RUN
#: Marks that stand in the text for found values, one per kind. Those of the text itself are set aside first.
_MARKS = {k: chr(0xFDD0 + i) for i, k in enumerate(("own", "email", "iban", "whole card", "date", "ssn", "ip", "phone", "card"))}
_ANY_MARK = "[" + "".join(_MARKS.values()) + "]"
#: Every pattern needs one of these characters, which a text without personal data seldom has.
CUE = "[0-9@]"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("0")).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> tuple[Column, Column]:
    """Permute pairs (a, b) with 0 <= a < size_a and 0 <= b < size_b: each round adds a digest of one half to the other.

    The fold carries both halves from round to round, so the expression stays small.
    """
    def digest(round_: Column, half: Column) -> Column:
        message = F.concat_ws("|", F.lit(key), tweak, size_a.cast("string"), size_b.cast("string"), round_.cast("string"),
                              half.cast("string"))
        return F.conv(F.substring(F.sha2(message, 256), 1, 15), 16, 10).cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(F.pmod(acc["a"] + digest(i, acc["b"]), size_a).alias("a"), acc["b"].alias("b"))
                      ).otherwise(F.struct(acc["a"].alias("a"), F.pmod(acc["b"] + digest(i, acc["a"]), size_b).alias("b")))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    both = F.aggregate(rounds, start, step)
    return both["a"], both["b"]


def permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Permute digit strings among all of their length (up to 36)."""
    low = F.floor(F.length(digits) / 2).cast("int")
    high = F.length(digits) - low
    size = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("bigint")
    a, b = feistel(_number(F.substr(digits, F.lit(1), low)), _number(F.substr(digits, low + 1, high)), size(low),
                   size(high), key, tweak)
    return F.concat(F.when(low > 0, F.lpad(a.cast("string"), low, "0")).otherwise(""), F.lpad(b.cast("string"), high, "0"))


def _laid_out(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced by ``digits``, in order."""
    step = lambda acc, c: F.when(c.between("0", "9"), F.struct(
        F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at")))
    return F.aggregate(F.split(layout, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step,
                       lambda acc: acc["out"])


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string whose last digit is the check digit."""
    weighed = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2 - 1, F.lit(9)) + F.when(c == "0", -8).otherwise(1)))
    return F.aggregate(weighed, F.lit(0), lambda acc, x: acc + x)


def _mod97(letters: Column) -> Column:
    """Remainder by 97 of an IBAN's characters, letters as two digits."""
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + _number(F.regexp_replace(c, "[^0-9]", "0"))) % 97).otherwise(
        (acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"), lambda acc, c: step(acc, c).cast("bigint"))


def _email(value: Column, key: str) -> Column:
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16)
    return F.concat(F.lit("u"), digest, F.lit("@pseudonym.invalid"))


def _card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = permuted_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, F.lit("card"))
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn(digits) % 10 == 0, _laid_out(value, F.concat(body, check)))


def _valid_iban(value: Column) -> Column:
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    return (F.length(plain) <= 34) & (_digits(F.substr(plain, F.lit(5))) != "") & (_mod97(moved) == 1)


def _iban(value: Column, key: str) -> Column:
    """Of a valid value."""
    plain = F.regexp_replace(value, " ", "")
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
    new_account = _laid_out(account, permuted_digits(_digits(account), key, F.concat(F.lit("iban"), country)))
    check = F.lpad((98 - _mod97(F.concat(new_account, country, F.lit("00")))).cast("string"), 2, "0")
    return _laid_out(value, F.concat(check, _digits(new_account)))


def _moved_day(day: Column, key: str) -> Column:
    """Permute days, numbered from ``FIRST_DAY`` on."""
    a, b = feistel(F.floor(day / DAY_HALVES[1]), F.pmod(day, F.lit(DAY_HALVES[1])), *[F.lit(n) for n in DAY_HALVES], key, F.lit("date"))
    return a * DAY_HALVES[1] + b


def _date(value: Column, key: str) -> Column:
    """ISO, day.month.year, or month/day/year; with a slash, day/month/year where only that is a date.

    All layouts share one permutation of days, so a day has one pseudonym however it is written. Only days written as
    day/month/year are moved on among those past the 12th, until their pseudonym cannot be read as month/day/year either;
    else two different dates could be written alike.
    """
    first = F.lit(FIRST_DAY).cast("date")
    on = lambda day: F.date_add(first, day.cast("int"))

    def moved(pattern: str, move: Callable[[Column, str], Column]) -> Column:
        day = F.datediff(F.try_to_date(value, pattern), first).cast("bigint")
        return F.when(day >= 0, F.date_format(on(move(day, key)), pattern))

    def past_the_12th(day: Column, key: str) -> Column:
        done = lambda d, step: (step > 1) & (F.dayofmonth(on(d)) > 12)
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), day, lambda d, step: F.when(
            done(d, step), d).otherwise(_moved_day(d, key).cast("bigint")))

    return F.when(value.contains("-"), moved("yyyy-MM-dd", _moved_day)).when(value.contains("."), moved("dd.MM.yyyy", _moved_day)).otherwise(
        F.coalesce(moved("MM/dd/yyyy", _moved_day), moved("dd/MM/yyyy", past_the_12th)))


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substr(value, F.lit(at), F.lit(n)).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    a, b = feistel(area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, F.lit(898),
                   F.lit(99 * 9999), key, F.lit("ssn"))
    new_area = a + 1 + F.when(a + 1 >= 666, 1).otherwise(0)
    new = F.concat_ws("-", F.lpad(new_area.cast("string"), 3, "0"), F.lpad((F.floor(b / 9999) + 1).cast("string"), 2, "0"),
                      F.lpad((b % 9999 + 1).cast("string"), 4, "0"))
    return F.when((area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0), new)


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("bigint"))
    a, b = feistel(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    new = F.concat_ws(".", *[x.cast("string") for half in (a, b) for x in (F.floor(half / 256), half % 256)])
    return F.when(F.forall(parts, lambda p: p < 256), new)


def _phone(value: Column, key: str) -> Column:
    """The ten national digits are permuted, a country code stays."""
    digits = _digits(value)
    code = F.length(digits) - 10
    national = permuted_digits(F.substr(digits, code + 1, F.lit(10)), key, F.lit("phone"))
    return _laid_out(value, F.concat(F.substr(digits, F.lit(1), code), national))


_MAKERS: dict[str, Callable[[Column, str], Column]] = {"date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone}
_PIECE = "struct<kind:string,new:string>"


def _piece(kind: str | None, new: Column) -> Column:
    return F.struct(F.lit(kind).cast("string").alias("kind"), new.alias("new"))


def _one(kind: str, new: Column, match: Column) -> Column:
    """The only piece of a match: its pseudonym, or the match itself where ``new`` is null."""
    return F.array(F.struct(F.when(new.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(new, match).alias("new")))


def _fixed(match: Column, key: str) -> Column:
    kind, new = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(_FIXED):
        full = match.rlike("^(?:" + PATTERNS[k].replace(_BOUND, "") + ")$")
        kind, new = F.when(full, F.lit(k)).otherwise(kind), F.when(full, _MAKERS[k](match, key)).otherwise(new)
    return F.array(F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, match).alias("new")))


def _pieces(run: Column, kind: str, width: int, choose: Callable[[Column], Column], make: Callable[[Column], Column]) -> Column:
    """``run`` as plain pieces and values of ``kind``, from the left, at group borders.

    ``choose`` gives ``first`` and ``other`` for the text from one group on, ``width`` groups long: valid values at its
    start or null. An ``other`` gives way to a ``first`` that begins within it.
    """
    n_groups = lambda value: F.size(F.split(value, "[ -]"))

    def tried(groups: Column) -> Column:
        def one(group: Column, i: Column) -> Column:
            ahead = F.array_join(F.slice(groups, i + 1, F.lit(width)), "")
            return F.struct(choose(F.regexp_replace(ahead, "^[ -]", "")).alias("of"), i.alias("at"))

        return F.transform(groups, one)

    def chosen(all_: Column) -> Column:
        """``at, end, value`` of those taken, which are far fewer than the groups."""
        def step(acc: Column, x: Column) -> Column:
            first, other = x["of"]["first"], x["of"]["other"]
            later = F.exists(F.slice(all_, x["at"] + 2, n_groups(other) - 1), lambda y: y["of"]["first"].isNotNull())
            value = F.coalesce(first, F.when(~later, other))
            taken = F.struct(x["at"].alias("at"), (x["at"] + n_groups(value)).alias("end"), value.alias("value"))
            return F.when((x["at"] >= acc["end"]) & value.isNotNull(), F.struct(
                F.concat(acc["out"], F.array(taken)).alias("out"), (x["at"] + n_groups(value)).alias("end"))).otherwise(acc)

        start = F.struct(F.array().cast("array<struct<at:int,end:int,value:string>>").alias("out"), F.lit(0).alias("end"))
        some = F.filter(all_, lambda x: x["of"]["first"].isNotNull() | x["of"]["other"].isNotNull())
        return F.aggregate(some, start, step, lambda acc: acc["out"])

    def laid(groups: Column, taken: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(taken, i - 1)["end"]).otherwise(0)
            plain = F.concat(F.array_join(F.slice(groups, before + 1, x["at"] - before), ""),
                             F.regexp_extract(F.get(groups, x["at"]), "^[ -]?", 0))
            return F.array(_piece(None, plain), _piece(kind, make(x["value"])))

        end = F.coalesce(F.get(taken, F.size(taken) - 1)["end"], F.lit(0))
        rest = _piece(None, F.array_join(F.slice(groups, end + 1, F.size(groups)), ""))
        return F.concat(F.flatten(F.transform(taken, one)), F.array(rest))

    return _bound(F.split(run, "(?=[ -])"), lambda groups: _bound(
        tried(groups), lambda all_: _bound(chosen(all_), lambda taken: laid(groups, taken))))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """Array ``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.flatten(F.transform(F.array(value), use))


def _first_valid(text: Column, patterns: list[str], valid: Callable[[Column], Column]) -> Column:
    """The first valid one of the parts of ``text`` that begin it and fit a pattern, or null."""
    parts = F.array(*[F.regexp_extract(text, "^(?:" + p + ")", 0) for p in patterns])
    return F.get(F.filter(parts, lambda part: F.when(part != "", valid(part)).otherwise(False)), F.lit(0))


def _whole_card(run: Column, key: str) -> Column:
    return _one("whole card", F.when(F.length(_digits(run)).between(min(CARD_DIGITS), max(CARD_DIGITS)), _card(run, key)), run)


def _cards(run: Column, key: str) -> Column:
    valid = lambda value: _luhn(_digits(value)) % 10 == 0
    lengths = [f"[0-9](?:[ -]?[0-9]){{{n - 1}}}{_END}" for n in CARD_DIGITS]
    return _pieces(run, "card", max(CARD_DIGITS), lambda ahead: F.struct(
        _first_valid(ahead, [_PRINTED_CARD], valid).alias("first"), _first_valid(ahead, lengths, valid).alias("other")),
        lambda value: _card(value, key))


def _ibans(run: Column, key: str) -> Column:
    """The length of the country, then the longest that looks like an IBAN."""
    return _pieces(run, "iban", 11, lambda ahead: F.struct(
        _first_valid(ahead, [_COUNTRY_IBAN], _valid_iban).alias("first"),
        _first_valid(ahead, [_ANY_IBAN + _END], _valid_iban).alias("other")), lambda value: _iban(value, key))


#: Pattern, the pieces of a match and their kinds, in the order of the search.
_SEARCHES: list[tuple[str, Callable[[Column, str], Column], tuple[str, ...]]] = [
    (_ANY_MARK, lambda m, key: _one("own", m, m), ("own",)),
    (PATTERNS["email"], lambda m, key: _one("email", _email(m, key), m), ("email",)),
    (IBAN_RUN, _ibans, ("iban",)), (WHOLE_CARD, _whole_card, ("whole card",)), (_ANY_FIXED, _fixed, _FIXED),
    (CARD_RUN, _cards, ("card",))]


def _filled(text: Column, mark: str, values: Column) -> Column:
    """``text`` with ``values`` in place of the marks, in order."""
    return F.array_join(F.zip_with(F.split(text, mark, -1), values, lambda part, v: F.concat(part, F.coalesce(v, F.lit("")))), "")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and, if named, array column ``found`` with the kind of each replaced value.

    Whole texts are searched; what is not valid (a failed check digit, an impossible date) stays as it is. A null text
    stays null, with no values found; empty texts, repeated rows and other columns are untouched. ``key`` is a secret
    parameter: the same key gives the same pseudonyms in every run.
    """
    body, masked, n = F.col(f"`{text}`"), free_name(docs, "pii_masked"), len(_SEARCHES)
    matches = [free_name(docs, f"pii_matches_{i}") for i in range(n)]
    has_cue = body.rlike(CUE)
    none = F.array().cast(f"array<array<{_PIECE}>>")
    marked = docs.withColumn(masked, F.when(has_cue, body))
    mark_of = F.create_map(*[F.lit(x) for pair in _MARKS.items() for x in pair])
    shown = lambda pieces: F.array_join(F.transform(pieces, lambda p: F.coalesce(mark_of[p["kind"]], p["new"])), "")
    for name, (pattern, pieces, _) in zip(matches, _SEARCHES):
        all_ = F.transform(F.regexp_extract_all(F.col(masked), F.lit(pattern), F.lit(0)), lambda m: pieces(m, key))
        marked = marked.withColumn(name, F.coalesce(all_, none))
        joined = F.array_join(F.zip_with(F.split(F.col(masked), pattern, -1), F.col(name), lambda part, m: F.concat(
            part, F.coalesce(shown(m), F.lit("")))), "")
        marked = marked.withColumn(masked, F.when(F.size(name) > 0, joined).otherwise(F.col(masked)))
    whole = F.col(masked)
    for name, (_, _, kinds) in reversed(list(zip(matches, _SEARCHES))):
        for kind in kinds:
            values = F.transform(F.filter(F.flatten(F.col(name)), lambda p: p["kind"] == kind), lambda p: p["new"])
            whole = _filled(whole, _MARKS[kind], values)
    whole = F.when(F.exists(F.array(*[F.size(name) for name in matches]), lambda size: size > 0), whole)
    columns = [F.coalesce(whole, body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found is not None:
        kind_of = F.create_map(*[F.lit(x) for k, m in _MARKS.items() if k != "own" for x in (m, k.removeprefix("whole "))])
        kinds = F.transform(F.regexp_extract_all(F.col(masked), F.lit(_ANY_MARK), F.lit(0)), lambda m: kind_of[m])
        columns.append(F.coalesce(F.filter(kinds, lambda k: k.isNotNull()), F.array().cast("array<string>")).alias(found))
    return marked.select(*columns)


def pii_table(docs: DataFrame, key: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, the text with pseudonyms, ``n_values`` replaced in all and per kind.

    Null texts stay null with no values, empty tables stay empty, repeated rows come out as often, null ids stay, and other
    columns are left out.
    """
    named = pseudonymise(docs.select(F.col(id), F.col(text)), key, text, "kinds")
    number = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("bigint")
    per_kind = [number(kind).alias(f"n_{kind}") for kind in KINDS]
    return named.select(id, text, F.size("kinds").cast("bigint").alias("n_values"), *per_kind)
