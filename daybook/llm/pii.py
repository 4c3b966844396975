"""Operator 8: personal data replaced by surrogates, with DataFrame functions only.

Found entities (email and IP addresses, phone, card and social security numbers, IBANs, names of
persons, access keys, passwords, tokens with or without a keyword, private keys and the user and password of
an address) get keyed surrogates of the same kind and format.  A
surrogate is a function of the key, the kind and the entity's canonical form, so one entity gets one
surrogate in all documents, in whatever format it is written, without any exchange:

* numbers keep their separators and length, phone numbers their first digit, card numbers their first
  digit and whether their check digit is right;
* names keep title, gender, script (Latin, Cyrillic or Greek) and number of words, and a surname stays
  one surname whether or not a given name stands before it;
* keys and passwords keep length and kinds of characters; email addresses stay addresses;
* tokens of a service keep its prefix, private keys (of up to 20,000 characters) their first and last line.

Collision check: the distinct entities of all documents are compared by surrogate, which is made once and
again only for those that try again.  Where two share
one, or a surrogate is itself a real entity, all but the least try again with the next attempt, until
all are distinct.  Only the entities with a later attempt are joined back, by text.  The entity table
is reduced before its exchange and never leaves the cluster.

Null texts stay null; empty texts stay empty.  All rows and columns stay; only ``text`` changes.
Repeated rows change alike.  Given names are distinct within their surname: joined names follow where
the list is used up.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm.common import cut, free_name, table
from daybook.llm.names import FEMALE, MALE, TITLES_ANY, TITLES_F, TITLES_M, either

KEY = "surrogates-1"
#: From this attempt on surrogates get longer; attempts end when all are distinct, or raise.
MOST_ATTEMPTS = 64
WIDER_ATTEMPTS = 32
LATIN, CYRILLIC, GREEK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
INITIALS = LATIN + CYRILLIC + GREEK

# Given names of surrogates by gender and script, syllables of surnames by script.
GIVEN = {
    ("m", "latin"): ["James", "John", "Robert", "Michael", "David", "William", "Thomas", "Peter", "Paul", "Mark", "Hans", "Karl", "Jean", "Pierre", "Carlos", "Juan"],
    ("f", "latin"): ["Mary", "Anna", "Linda", "Susan", "Karen", "Sarah", "Emma", "Laura", "Julia", "Helen", "Greta", "Marie", "Claire", "Sophie", "Carmen", "Lucia"],
    ("m", "cyrillic"): ["Иван", "Пётр", "Сергей", "Андрей", "Михаил", "Павел", "Николай", "Олег"],
    ("f", "cyrillic"): ["Анна", "Мария", "Ольга", "Елена", "Наталья", "Ирина", "Татьяна", "Вера"],
    ("m", "greek"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος", "Πέτρος", "Ανδρέας"],
    ("f", "greek"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Δήμητρα", "Ιωάννα", "Αγγελική"],
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha he ka ke la le li lo ma me mi mo na ne ni no ra re ri ro sa ta".split(),
    "cyrillic": "ба бе бо да де до га ге ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се та те ва ве".split(),
    "greek": "βα βε βο δα δε δο γα γε κα κε λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε τα τε πα πε".split(),
}

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NAME = r"\p{Lu}[\p{L}'’-]+(?![\p{L}\p{N}_])"
_INITIALS = r"(?:(?:\p{Lu}\.)+ )*"
_FIRST = either(MALE + FEMALE)
_TITLES = TITLES_M + TITLES_F + TITLES_ANY
_TITLED = f"(?:(?:{either(_TITLES)})\\.? ){{1,3}}"
#: What a name begins with: a capital, or the first letter of a lower-case title.
_BEGIN = "[\\p{Lu}" + "".join(sorted({t[0] for t in _TITLES if t[0].islower()})) + "]"
#: A keyword (whatever word characters stand before it) up to the value, and the value.
_SECRET_WORD = (
    r"(?:(?i:authorization[\"']?[ \t]*[=:][ \t]*[\"']?(?:bearer|basic|token)[ \t]+)"
    r"|(?:[Bb]earer|BEARER) +(?=[A-Za-z._~+/-]*[0-9])(?=[\w.~+/=-]{16})"
    r"|(?i:(?:password|passwd|passphrase|passcode|pwd|secret|token|credential|(?:api|access|private|auth|encryption|account)[_-]?key)"
    r"(?:[_-][\w-]{1,40}|(?-i:[A-Z])\w{1,40}|[0-9]{1,3})?[\"']?[ \t]*(?::=|=>|[=:])[ \t]*))"
)
_SECRET_BARE = r"[^\s\"']"
#: What tokens of well-known services begin with, and the characters that follow.
_TOKEN_BEGIN = r"gh[pousr]_|github_pat_|glpat-|sk-(?:proj-|svcacct-)?|[srp]k_(?:live|test)_|xox[abeprs]-|AIza|npm_|hf_|eyJ"
_TOKEN = (
    r"(?:(?:gh[pousr]_|[srp]k_(?:live|test)_)[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[\w-]{16,}"
    r"|sk-(?:proj-|svcacct-)?(?=[A-Za-z_-]*[0-9])[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[\w-]{30,}"
    r"|(?:npm_|hf_)[A-Za-z0-9]{24,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})"
)
_PEM_LINE = r"-----(?:BEGIN|END) [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: Values that have a kind of their own also behind a keyword.
_OWN_KIND = rf"[\"']?(?:AKIA[0-9A-Z]{{16}}\b|{_TOKEN}(?![^\s\"',;)\]}}])|-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kind and pattern, in the order in which they are tried at a place.
KINDS = {
    "login": rf"://[^\s/:@\"'<>]*:(?!{_TOKEN}@)[^\s/@\"'<>]+@",
    "token": rf"(?<![\p{{L}}\p{{N}}_-]){_TOKEN}",
    "private_key": rf"{_PEM_LINE.replace('(?:BEGIN|END)', 'BEGIN')}(?s:.{{1,20000}}?){_PEM_LINE.replace('(?:BEGIN|END)', 'END')}",
    "secret": rf"{_SECRET_WORD}(?!{_OWN_KIND})(?:\"[^\"\n]+\"|'[^'\n]+'|[\"']?{_SECRET_BARE}{{6,}}[\"']?"
    rf"|(?<=(?i:password|passwd|passphrase|passcode|pwd)[\"']?[ \t]{{0,9}}[=:][ \t]{{0,9}}){_SECRET_BARE}+)",
    "access_key": r"\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f]{{0,4}}:)(?=[0-9A-Fa-f:]*[0-9]|(?:[0-9A-Fa-f]*:){{3}})"
    rf"(?:(?:{_HEX}:){{7}}{_HEX}|(?=(?:::)?(?:{_HEX}::?){{0,7}}{_HEX}?(?![0-9A-Fa-f:]))(?:{_HEX}(?::{_HEX}){{0,6}})?::(?:{_HEX}(?::{_HEX}){{0,6}})?)"
    r"(?![\p{L}\p{N}:]|\.[0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])(?:1[ .-])?[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
    # national numbers: with a leading zero, in 9 to 11 digits, and of ten digits as in North America
    r"|\(0[0-9]{1,4}\) ?[0-9]{2,8}(?:[ -][0-9]{2,4}){0,3}(?![0-9])"
    r"|(?<![\p{L}\p{N}.,+_/:-])(?=0(?:[ /-]?[0-9]){8,10}(?! ?[0-9]))0[1-9][0-9]{0,3}[ /-]?[0-9]{2,8}(?: ?[0-9]{2,4}){0,4}(?![0-9]|[.,:/-][0-9])"
    r"|(?<![\p{L}\p{N}.,+_/:-])(?<![0-9] )(?:1 ?)?[2-9][0-9]{2} ?[2-9][0-9]{2} ?[0-9]{4}(?![\p{L}\p{N}_]| [0-9]|[.,:/-][0-9])",
    "card": r"(?<![0-9])[3-6](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?={_BEGIN})(?:{_TITLED}{_INITIALS}{_NAME}(?: {_INITIALS}{_NAME}){{0,2}}"
    rf"|{_FIRST} (?:(?:{_FIRST}|(?:\p{{Lu}}\.)+) )?{_NAME})",
}
#: First characters of three kinds, told before their many alternatives are tried.
STARTS = {"token": "(?=[gsrpxAnhe])", "secret": "(?=[PpSsTtCcAaEeBb])", "phone": "(?=[+(0-9])"}
ANY = "|".join(f"(?:{STARTS.get(k, '')}(?:{p}))" for k, p in KINDS.items())
#: A text without either holds no entity and is not searched further.  The second looks at names only
#: where a word begins as a name does.
SIGNS = f"[0-9@=:]|AKIA|-----BEGIN|{_TOKEN_BEGIN}"
NAME_SIGN = f"(?:^|[^\\p{{L}}])(?={_BEGIN})(?:{_TITLED}|{_FIRST} )\\p{{Lu}}"


def may_hold(text: Column) -> Column:
    return text.rlike(SIGNS) | text.rlike(NAME_SIGN)


def _const(values: list[str]) -> Column:
    return F.split(F.lit(" ".join(values)), " ")


def _pick(values: list[str], number: Column) -> Column:
    return F.get(_const(values), F.pmod(number, F.lit(len(values))).cast("int"))


def kind_of(match: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _between(kind: str, match: Column, part: int) -> Column:
    """What stands before, within or after the value of a login or private key."""
    first, last = ("://", "@") if kind == "login" else (_PEM_LINE, _PEM_LINE)
    return F.regexp_extract(match, f"(?s)^({first})(.+?)({last})$", part)


def _secret(match: Column, part: int) -> Column:
    """Keyword and opening quote, value, or closing quote of a secret."""
    return F.regexp_extract(match, rf"^({_SECRET_WORD}[\"']?)(.+?)([\"']?)$", part)


def _name_parts(match: Column) -> tuple[Column, Column, Column]:
    """Title, words and whether female, of a name."""
    title = F.regexp_extract(match, f"^({_TITLED})", 1)
    words = F.split(F.substr(match, F.length(title) + 1), " ")
    female = title.rlike(f"(?:^| )(?:{either(TITLES_F)})\\.? ") | (
        ~title.rlike(f"(?:^| )(?:{either(TITLES_M)})\\.? ") & F.get(words, F.lit(0)).rlike(f"^(?:{either(FEMALE)})$")
    )
    return title, words, female


def _given_canon(word: Column, surname: Column, female: Column) -> Column:
    """A given name is an entity within its surname."""
    return F.concat_ws("\u0002", F.lower(surname), F.lower(word), F.when(female, "f").otherwise("m"))


def _is_initials(word: Column) -> Column:
    return word.rlike(r"^(?:\p{Lu}\.)+$")


def _hextets(match: Column) -> Column:
    """All eight groups of an IPv6 address, lower-case and without leading zeros."""
    sides = F.split(F.lower(match), "::")
    groups = [F.filter(F.split(F.coalesce(F.get(sides, F.lit(i)), F.lit("")), ":"), lambda g: g != "") for i in (0, 1)]
    zeros = F.array_repeat(F.lit("0"), 8 - F.size(groups[0]) - F.size(groups[1]))
    every = F.concat(groups[0], zeros, groups[1])
    return F.array_join(F.transform(every, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def canonical(kind: Column, match: Column) -> Column:
    """What two mentions of one entity share."""
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(match, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind == "email", F.lower(match))
        .when(kind == "secret", _secret(match, 2))
        .when(kind == "login", _between("login", match, 2))
        .when(kind == "private_key", _between("private_key", match, 2))
        .when(kind == "ipv6", _hextets(match))
        .when(kind == "name", F.lower(F.regexp_extract(match, r"([^ ]+)$", 1)))
        .otherwise(match)
    )


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits."""
    first = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")), 256)
    return F.concat(first, F.sha2(F.concat(F.lit(key), first), 256))


def _number(hashed: Column, start: int) -> Column:
    return F.conv(F.substring(hashed, start, 6), 16, 10).cast("int")


def _number_at(hashed: Column, i: Column) -> Column:
    return F.conv(F.substr(hashed, (F.pmod(i, F.lit(20)) * 6 + 1).cast("int"), F.lit(6)), 16, 10).cast("int")


def _check_digit(payload: Column) -> Column:
    """The digit that makes a card number of this payload valid."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(payload, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(10 - total % 10, F.lit(10))


def _like_characters(value: Column, hashed: Column, token: str = "(?s).") -> Column:
    """Digits for digits, letters for letters of the same case; hexadecimal values and escaped line ends stay so."""
    span = F.when(value.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), 6).otherwise(26)

    def change(char: Column, i: Column) -> Column:
        number = F.conv(F.substr(hashed, F.pmod(i * 2, F.lit(126)).cast("int") + 1, F.lit(2)), 16, 10).cast("int")
        letter = F.chr((number % span + 97).cast("long"))
        return (
            F.when(F.length(char) > 1, char)
            .when(char.rlike("[0-9]"), (number % 10).cast("string"))
            .when(char.rlike(r"\p{Lu}"), F.upper(letter))
            .when(char.rlike(r"\p{L}"), letter)
            .otherwise(char)
        )

    return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(token), 0), change), "")


def _surname(canon: Column, hashed: Column, attempt: Column) -> Column:
    """Four syllables, and one more for every four attempts."""

    def of(script: str) -> Column:
        parts = [_pick(SYLLABLES[script], _number(hashed, 1 + 6 * i)) for i in range(4)]
        more = F.transform(
            F.sequence(F.lit(4), F.floor(attempt / 4) + 4), lambda i: _pick(SYLLABLES[script], _number_at(hashed, i))
        )
        return F.concat(*parts, F.array_join(F.slice(more, F.lit(2), F.size(more) - 1), ""))

    return (
        F.when(canon.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    )


def _given(canon: Column, hashed: Column, attempt: Column) -> Column:
    """Surname and a name of the same gender and script; one more joined to it for every four attempts."""
    word, gender = F.substring_index(canon, "\u0002", 2), F.substring_index(canon, "\u0002", -1)
    word = F.substring_index(word, "\u0002", -1)

    def of(script: str) -> Column:
        def name(i: Column) -> Column:
            number = _number_at(hashed, i)
            return F.when(gender == "f", _pick(GIVEN[("f", script)], number)).otherwise(_pick(GIVEN[("m", script)], number))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 4)), name), "-")

    made = F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))
    return F.concat_ws("\u0002", F.substring_index(canon, "\u0002", 1), made)


def core(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical form of the surrogate.

    From ``MOST_ATTEMPTS`` on the format is held to be full: every attempt makes the surrogate one
    character longer, and an IPv4 address becomes an IPv6 address, so that there is always room.
    """
    return _bound(_hash(key, kind, canon, attempt), lambda hashed: _core(key, kind, canon, attempt, hashed))


def _core(key: str, kind: Column, canon: Column, attempt: Column, hashed: Column) -> Column:
    digits = F.translate(hashed, "abcdef", "012345")
    wide = F.greatest(attempt - (MOST_ATTEMPTS - 1), F.lit(0))
    size = F.length(canon) + wide
    kept = F.substring(canon, 1, 1)
    phone = F.concat(kept, F.translate(F.substring(digits, 1, 1), "01", "23"), F.substr(digits, F.lit(2), size - 2))
    payload = F.concat(kept, F.substr(digits, F.lit(1), size - 2))
    right = _check_digit(F.substr(canon, F.lit(1), F.length(canon) - 1)) == F.substring(canon, -1, 1).cast("int")
    card = F.concat(payload, F.pmod(_check_digit(payload) + F.when(right, 0).otherwise(1), F.lit(10)).cast("string"))
    octets = [(F.pmod(_number(hashed, 1 + 6 * i), F.lit(254)) + 1).cast("string") for i in range(4)]
    hextets = [F.regexp_replace(F.substring(hashed, 1 + 4 * i, 4), "^0+(?=.)", "") for i in range(6)]
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *hextets)
    email = F.concat(
        F.lower(_pick(GIVEN[("m", "latin")] + GIVEN[("f", "latin")], _number(hashed, 1))),
        F.lit("."),
        _surname(F.lit("a"), F.substring(hashed, 7, 60), F.lit(0)),
        F.substring(digits, 70, 4),
        F.lit("@mail"),
        F.substring(F.sha2(F.concat(F.lit(key), F.regexp_extract(canon, "@(.*)$", 1)), 256), 1, 6),
        F.lit(".example.org"),
    )

    def widened(value: Column) -> Column:
        return F.concat(value, F.repeat(F.lit("a"), wide))

    access = F.concat(F.lit("AKIA"), _like_characters(widened(F.substring(canon, 5, 16)), hashed))
    begin = F.regexp_extract(canon, f"^(?:{_TOKEN_BEGIN})", 0)
    token = F.concat(begin, _like_characters(widened(F.substr(canon, F.length(begin) + 1)), hashed))
    iban = F.concat(F.substring(canon, 1, 2), _like_characters(F.upper(widened(F.substr(canon, F.lit(3)))), hashed))
    return (
        F.when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "ssn", F.substr(digits, F.lit(1), size))
        .when(kind == "ip", F.when(wide > 0, ipv6).otherwise(F.concat_ws(".", *octets)))
        .when(kind == "ipv6", ipv6)
        .when(kind == "email", email)
        .when(kind == "access_key", access)
        .when(kind == "iban", iban)
        .when(kind == "token", token)
        .when(kind.isin("secret", "login"), _like_characters(widened(canon), hashed))
        .when(kind == "private_key", _like_characters(widened(canon), hashed, r"(?s)\\[nr]|."))
        .when(kind == "given", _given(canon, hashed, attempt))
        .otherwise(_surname(canon, hashed, attempt))
    )


def _laid_out(match: Column, made: Column, what: str) -> Column:
    """The characters of ``made`` at the places of ``what`` in ``match``; those left over at its end."""

    def place(char: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(match, F.lit(1), i + 1), f"[^{what}]", ""))
        return F.when(char.rlike(f"[{what}]"), F.substr(made, before, F.lit(1))).otherwise(char)

    laid = F.array_join(F.transform(F.regexp_extract_all(match, F.lit("(?s)."), 0), place), "")
    return F.concat(laid, F.substr(made, F.length(F.regexp_replace(match, f"[^{what}]", "")) + 1))


def _turned(key: str) -> str:
    """The initials of each script, moved on by a keyed number of places: distinct ones stay so."""
    out = ""
    for script in (LATIN, CYRILLIC, GREEK):
        by = 1 + int(hashlib.sha256(f"{key} initials".encode()).hexdigest(), 16) % (len(script) - 1)
        out += script[by:] + script[:by]
    return out


def _name(key: str, match: Column, made: Column, attempt_of) -> Column:
    """Title, given names of the same gender and script, and the new surname."""
    title, words, female = _name_parts(match)
    surname = F.element_at(words, -1)

    def given(word: Column) -> Column:
        canon, kind = _given_canon(word, surname, female), F.lit("given")
        new = F.substring_index(_bound(attempt_of(kind, canon), lambda n: _given(canon, _hash(key, kind, canon, n), n)), "\u0002", -1)
        return F.when(_is_initials(word), F.translate(word, INITIALS, _turned(key))).otherwise(new)

    cased = F.when(surname.rlike(r"^[\p{Lu}'’-]+$"), F.upper(made)).otherwise(F.initcap(made))
    firsts = F.transform(F.slice(words, F.lit(1), F.size(words) - 1), given)
    return F.concat(title, F.array_join(F.concat(firsts, F.array(cased)), " "))


def surrogate(key: str, match: Column, attempt_of) -> Column:
    """The text that takes the place of a match; ``attempt_of`` gives the attempt of (kind, canonical)."""

    def with_kind(kind: Column) -> Column:
        def with_canon(canon: Column) -> Column:
            made = core(key, kind, canon, attempt_of(kind, canon))
            secret = F.concat(_secret(match, 1), made, _secret(match, 3))
            login, private = (F.concat(_between(k, match, 1), made, _between(k, match, 3)) for k in ("login", "private_key"))
            return (
                F.when(kind.isin("phone", "card", "ssn"), _laid_out(match, made, "0-9"))
                .when(kind == "iban", _laid_out(match, made, "0-9A-Z"))
                .when(kind == "secret", secret)
                .when(kind == "login", login)
                .when(kind == "private_key", private)
                .when(kind == "name", _name(key, match, made, attempt_of))
                .otherwise(made)
            )

        return _bound(canonical(kind, match), with_canon)

    return _bound(kind_of(match), with_kind)


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def replaced(text: Column, key: str, attempt_of) -> Column:
    """``text`` with every entity replaced, and the kinds of the entities, as a struct."""
    pair = F.struct(
        F.regexp_extract_all(text, F.lit(ANY), 0).alias("found"), F.split(text, ANY, -1).alias("between")
    )

    def rebuild(p: Column) -> Column:
        changed = F.transform(
            p["found"], lambda m, i: F.concat(F.get(p["between"], i), surrogate(key, m, attempt_of))
        )
        whole = F.concat(F.array_join(changed, ""), F.get(p["between"], F.size(p["found"])))
        return F.struct(whole.alias("text"), F.transform(p["found"], kind_of).alias("kinds"))

    nothing = F.struct(text.alias("text"), F.array().cast("array<string>").alias("kinds"))
    return F.when(may_hold(text), _bound(pair, rebuild)).otherwise(nothing)


def entities(docs: DataFrame) -> DataFrame:
    """(text, kind, canon) of every mention."""
    found = docs.where(may_hold(F.col("text"))).select(
        "text", F.explode(F.regexp_extract_all("text", F.lit(ANY), 0)).alias("match")
    )
    kind, match = F.col("kind"), F.col("match")
    title, words, female = _name_parts(match)
    firsts = F.filter(F.slice(words, F.lit(1), F.size(words) - 1), lambda w: ~_is_initials(w))
    given = F.transform(
        firsts, lambda w: F.struct(F.lit("given").alias("kind"), _given_canon(w, F.element_at(words, -1), female).alias("canon"))
    )
    itself = F.array(F.struct(kind.alias("kind"), canonical(kind, match).alias("canon")))
    every = F.when(kind == "name", F.concat(itself, given)).otherwise(itself)
    return found.withColumn("kind", kind_of(match)).select("text", F.explode(every).alias("entity")).select("text", "entity.*")


def attempts(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate is not their own alone.

    A value without letters and digits, such as a masked password, tells nothing and stays as it is.
    """
    telling = entities(docs).select("kind", "canon").where(
        r"kind NOT IN ('secret', 'login', 'private_key') OR canon RLIKE '[0-9\\p{L}]'"
    )
    none = F.lit(0)
    known = cut(
        telling.distinct().select("kind", "canon", none.alias("attempt"), core(key, F.col("kind"), F.col("canon"), none).alias("made"))
    )
    real = known.select("kind", F.col("canon").alias("made"))
    for _ in range(MOST_ATTEMPTS + WIDER_ATTEMPTS):
        first = known.groupBy("kind", "made").agg(
            F.min(F.struct("attempt", "canon"))["canon"].alias("owner"), F.count("*").alias("claims")
        )
        shared = first.where("claims > 1").select("kind", "made", "owner")
        clash = first.join(real, ["kind", "made"], "left_semi").select("kind", "made", F.lit(None).cast("string").alias("owner"))
        again = known.join(
            shared.unionByName(clash).groupBy("kind", "made").agg(F.min("owner").alias("owner"), F.max(F.col("owner").isNull()).alias("real")),
            ["kind", "made"],
        ).where("real OR canon <> owner")
        losers = cut(again.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        if losers.isEmpty():
            return known.where("attempt > 0").drop("made")
        known = cut(
            known.join(losers.withColumnRenamed("attempt", "next"), ["kind", "canon"], "left").select(
                "kind",
                "canon",
                F.coalesce("next", "attempt").alias("attempt"),
                F.when(F.col("next").isNull(), F.col("made"))
                .otherwise(core(key, F.col("kind"), F.col("canon"), F.col("next")))
                .alias("made"),
            )
        )
    raise RuntimeError("surrogates of distinct entities still coincide")


def _with_replaced(docs: DataFrame, key: str, name: str) -> DataFrame:
    """``docs`` and a struct column of the new text and the kinds found."""
    later = attempts(docs, key)
    if later.isEmpty():
        return docs.withColumn(name, replaced(F.col("text"), key, lambda kind, canon: F.lit(0)))
    digest, retry = free_name(docs, "_digest"), free_name(docs, "_retry")
    by_text = (
        entities(docs)
        .select(F.sha2("text", 256).alias(digest), "kind", "canon")
        .join(later, ["kind", "canon"])
        .select(digest, F.concat_ws("\u0001", "kind", "canon").alias("entity"), "attempt")
        .distinct()
        .groupBy(digest)
        .agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias(retry))
    )
    joined = docs.withColumn(digest, F.sha2("text", 256)).join(by_text, digest, "left")

    def attempt_of(kind: Column, canon: Column) -> Column:
        return F.coalesce(F.element_at(F.col(retry), F.concat_ws("\u0001", kind, canon)), F.lit(0))

    return joined.withColumn(name, replaced(F.col("text"), key, attempt_of)).drop(digest, retry)


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``; all other columns as they are."""
    name = free_name(docs, "_replaced")
    changed = _with_replaced(docs, key, name)
    return changed.select(
        *[(F.col(name)["text"].alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns]
    )


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds): the new text of every document and what was replaced in it."""
    changed = _with_replaced(docs.select("doc_id", "text"), key, "made")
    return changed.select(
        "doc_id",
        F.col("made")["text"].alias("text"),
        F.size(F.col("made")["kinds"]).alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.col("made")["kinds"])), ",").alias("kinds"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))
