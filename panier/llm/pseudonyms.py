"""Format-preserving pseudonyms, in DataFrame operations only.

Numbers and dates that validate are permuted within their format by a keyed Feistel network, so that equal values stay equal in all
documents, different ones stay different, and the result validates as well:

* card numbers (13 to 19 digits of a valid Luhn sum, in any groups; the first digit is kept),
* North American telephone numbers (any after +1, otherwise area and exchange begin with 2 to 9), numbers with another country code
  (code kept), with separators or without,
* IPv4 addresses, social security numbers (of the valid areas), dates from 1900 to 2099.

The network alternates additions modulo two halves a and b of a domain of exactly a * b values (dates: 17 * 4297 days), so
nothing has to be retried.  E-mail addresses are neither numbers nor dates; they get a keyed name at a reserved domain.

Edge cases: a null text stays null, an empty one empty; a text of any length is read whole, in time that grows with it; a value that does not validate stays as it is; repeated rows have equal
results; a null doc_id is kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "panier-demonstration-key"
ROUNDS = 10
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
# Each begins where no longer run of its own characters does, so a text is read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IP = rf"(?<![0-9A-Za-z.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
DATE = r"(?<![0-9A-Za-z/.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|(?:19|20)[0-9]{2}/[01][0-9]/[0-3][0-9]|[0-3][0-9]\.[01][0-9]\.(?:19|20)[0-9]{2}|[0-3][0-9]/[0-3][0-9]/(?:19|20)[0-9]{2})(?![0-9A-SU-Za-z/-]|T(?![0-9]{2}:)|\.[0-9])"
PHONE = r"(?<![0-9A-Za-z+])\+1(?:[ .-]{0,2}\(?[0-9]\)?){10}(?![0-9A-Za-z])|(?<![0-9A-Za-z+(])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
ABROAD = r"(?<![0-9A-Za-z+])\+(?!1[ .(-])[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{1,5}\)?[ .-]?){1,4}[0-9]{2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[2-9](?:[ .-]{0,2}\(?[0-9]\)?){6,14}(?![0-9A-Za-z])"
#: Country codes of one and two digits; all others have three.
CODES = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# A number without separators; or a run of groups, which ends where one of the other kinds or a number without separators begins.
COMPACT = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
DOTTED = r"(?<![0-9A-Za-z])[0-9]{4}(?:\.[0-9]{4,6}){1,3}\.[0-9]{1,7}(?![0-9A-Za-z])"
#: Digits of a run beyond the first; a longer run is several.
RUN = rf"(?<![0-9A-Za-z])[0-9](?:[ -]?(?!{IP}|{SSN}|{DATE}|{PHONE}|{COMPACT})[0-9]){{12,400}}(?![0-9A-Za-z])"
CARD = f"{COMPACT}|{DOTTED}|{RUN}"
KINDS = {"email": EMAIL, "ip": IP, "ssn": SSN, "date": DATE, "phone": PHONE, "abroad": ABROAD, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What a text needs to be looked at: no kind is without a digit or the sign of an address.
HINT = "[0-9@]"
DATES = (("[0-9]{4}-.*", "yyyy-MM-dd"), ("[0-9]{4}/.*", "yyyy/MM/dd"), (r"[0-9]{2}\..*", "dd.MM.yyyy"), ("[0-9]{2}/.*", "dd/MM/yyyy"), ("(?:0[0-9]|1[0-2])/.*", "MM/dd/yyyy"))


def _random(key: str, kind: str, turn: Column, half: Column, modulus: Column) -> Column:
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), modulus.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long") % modulus


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """A permutation of the pairs (left below a, right below b), as a struct (l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    a, b = a.cast("long"), b.cast("long")

    def turn(x, i):
        return F.when(i % 2 == 0, F.struct(((x["l"] + _random(key, kind, i, x["r"], a)) % a).alias("l"), x["r"].alias("r"))).otherwise(
            F.struct(x["l"].alias("l"), ((x["r"] + _random(key, kind, i, x["l"], b)) % b).alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _with(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i) for i in range(19)]), n + 1)


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def digits(d: Column, key: str, kind: str) -> Column:
    """A permutation of the digit strings of d's length (2 to 18)."""
    n = F.length(d)
    h = F.floor(n / 2).cast("int")
    out = lambda x: F.concat(_padded(x["l"], h), _padded(x["r"], n - h))
    return _with(feistel(F.substring(d, F.lit(1), h), F.substring(d, h + 1, n - h), _power(h), _power(n - h), key, kind), out)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _filled(m: Column, new: Column) -> Column:
    """``m`` with its digits replaced, in order, by those of ``new``."""
    ch = lambda i: F.substring(m, i, F.lit(1))
    at = lambda i: F.length(_only_digits(F.substring(m, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(ch(i).rlike("[0-9]"), F.substring(new, at(i), F.lit(1))).otherwise(ch(i))), "")


def luhn(d: Column) -> Column:
    """The sum, modulo 10, of digits of which every second from the last but one counts doubled (less 9 where that passes 9)."""
    n = F.length(d)
    x = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda v: F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, twice(x(i))).otherwise(x(i))) % 10


def _card(m: Column, key: str) -> Column:
    def of(d):
        n = F.length(d)
        body = F.concat(F.substring(d, F.lit(1), F.lit(1)), digits(F.substring(d, F.lit(2), n - 2), key, "card"))
        # The last digit is set so that the sum is what it was.
        return _with(body, lambda x: F.concat(x, F.pmod(luhn(d) - luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    return _with(_only_digits(m), lambda d: _filled(m, of(d)))


def _pieces(m: Column) -> Column:
    """A run's groups of digits, those that make up a card number in one piece: an array of structs (s, card)."""
    groups = F.regexp_extract_all(m, F.lit("[0-9]+[^0-9]?"), F.lit(0))

    def of(g):
        def valid(i, n):
            d = _only_digits(F.array_join(F.slice(g, i, n), ""))
            return F.when(F.length(d).between(13, 19), luhn(d) == 0).otherwise(F.lit(False))

        def add(state, i):
            # The most groups that are valid together, 0 if none.
            most = F.greatest(F.lit(0), F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(19), F.size(g) - i + 1)), lambda n: valid(i, n))))
            piece = lambda n: F.struct((i + F.greatest(n, F.lit(1))).alias("next"), F.concat(state["out"], F.array(F.struct(F.array_join(F.slice(g, i, F.greatest(n, F.lit(1))), "").alias("s"), (n > 0).alias("card")))).alias("out"))
            return F.when(i < state["next"], state).otherwise(_with(most, piece))

        start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<s:string,card:boolean>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, add)["out"]

    return _with(groups, of)


def _cards(m: Column, key: str) -> Column:
    return F.array_join(F.transform(_pieces(m), lambda x: F.when(x["card"], _card(x["s"], key)).otherwise(x["s"])), "")


def _phone(m: Column, key: str) -> Column:
    def of(d):  # d: the last ten digits
        part = lambda i, n: F.substring(d, F.lit(i), F.lit(n)).cast("long")
        # Numbers of valid areas and exchanges are permuted among themselves, and so are those of other areas, and of other exchanges.
        line = part(4, 3) * 10000 + part(7, 4)
        least, a = F.when(part(1, 3) < 200, 0).otherwise(200), F.when(part(1, 3) < 200, 200).otherwise(800)
        first = F.when((part(1, 3) >= 200) & (part(4, 3) >= 200), 2_000_000).otherwise(0)
        b = F.when(part(1, 3) < 200, 10_000_000).when(part(4, 3) < 200, 2_000_000).otherwise(8_000_000)
        new = feistel(part(1, 3) - least, line - first, a, b, key, "phone")
        return _with(new, lambda x: F.concat(_padded(x["l"] + least, F.lit(3)), _padded(x["r"] + first, F.lit(7))))

    return _with(_only_digits(m), lambda d: _filled(m, F.concat(F.substring(d, F.lit(1), F.length(d) - 10), of(F.substring(d, F.length(d) - 9, F.lit(10))))))


def _abroad(m: Column, key: str) -> Column:
    length = lambda d: F.when(d.rlike("^[17]"), 1).when(d.rlike(f"^{CODES}"), 2).otherwise(3)
    return _with(_only_digits(m), lambda d: _with(length(d), lambda code: _filled(m, F.concat(F.substring(d, F.lit(1), code), digits(F.substring(d, code + 1, F.length(d) - code), key, "abroad")))))


def _ip(m: Column, key: str) -> Column:
    o = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    new = feistel(o(1) * 256 + o(2), o(3) * 256 + o(4), F.lit(65536), F.lit(65536), key, "ip")
    return _with(new, lambda x: F.concat_ws(".", *[f.cast("string") for f in (F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256)]))


def _ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666 are numbered without a gap; groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.split_part(m, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    place = area - 1 - (area > 666).cast("long")
    new = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    back = lambda x: x["l"] + 1 + (x["l"] >= 665).cast("long")
    return _with(new, lambda x: F.concat_ws("-", _padded(back(x), F.lit(3)), _padded(F.floor(x["r"] / 9999) + 1, F.lit(2)), _padded(x["r"] % 9999 + 1, F.lit(4))))


def _day(m: Column) -> Column:
    """Days since 1900-01-01, or null where there is no such date."""
    out = F.lit(None).cast("date")
    for shape, form in DATES:
        out = F.coalesce(F.when(m.rlike(f"^{shape}$"), F.try_to_timestamp(m, F.lit(form)).cast("date")), out)
    return F.datediff(out, F.lit("1900-01-01").cast("date"))


def _date(m: Column, key: str) -> Column:
    new = lambda n: feistel(F.floor(n / 4297), n % 4297, F.lit(17), F.lit(4297), key, "date")
    day = lambda x: F.date_add(F.lit("1900-01-01").cast("date"), (x["l"] * 4297 + x["r"]).cast("int"))

    def shaped(d):
        out = F.lit(None).cast("string")
        for shape, form in DATES:
            out = F.when(m.rlike(f"^{shape}$") & F.try_to_timestamp(m, F.lit(form)).isNotNull(), F.date_format(d, form)).otherwise(out)
        return out

    return _with(_day(m), lambda n: F.when(n.isNull(), m).otherwise(_with(new(n), lambda x: shaped(day(x)))))


def _email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 16), F.lit("@pseudonym.invalid"))


def kind_of(m: Column) -> Column:
    """The kind of a match; null for a date that is none and for a number that is no card's."""
    out = F.when(m.contains("@"), "email")
    for k, p in KINDS.items():
        if k != "email":
            valid = _day(m).isNotNull() if k == "date" else F.exists(_pieces(m), lambda x: x["card"]) if k == "card" else F.lit(True)
            out = out.when(m.rlike(f"^(?:{p})$"), F.when(valid, k))
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(m, key)).when(kind == "ip", _ip(m, key)).when(kind == "ssn", _ssn(m, key)).when(kind == "date", _date(m, key))
        .when(kind == "phone", _phone(m, key)).when(kind == "abroad", _abroad(m, key)).when(kind == "card", _cards(m, key)).otherwise(m)
    )


def pseudonymised(docs: DataFrame, key: str = KEY, text_col: str = "text") -> DataFrame:
    """``docs`` with its text pseudonymised, and the column pii: the kinds found, in order of place."""
    text = F.col(text_col)
    has = text.rlike(HINT)
    found = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    marked = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    rows = docs.withColumn("_pii_", marked)
    some = F.size("_pii_") > 0
    # A run can hold several cards.
    times = lambda x: F.when(x["kind"] == "card", F.size(F.filter(_pieces(x["m"]), lambda y: y["card"]))).otherwise(F.when(x["kind"].isNull(), 0).otherwise(1))
    kinds = lambda x: F.array_repeat(x["kind"], times(x))
    new = F.transform("_pii_", lambda x: pseudonym(x["m"], x["kind"], key))
    whole = F.array_join(F.zip_with(F.split(text, ANY), new, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return rows.withColumn(text_col, F.when(some, whole).otherwise(text)).withColumn("pii", F.coalesce(F.flatten(F.transform("_pii_", kinds)), F.array().cast("array<string>"))).drop("_pii_")


def pii(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (pseudonymised), changed, and the number of values of each kind."""
    rows = pseudonymised(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), key)
    count = lambda *kinds: F.size(F.filter("pii", lambda k: k.isin(*kinds))).cast("long")
    return rows.select(
        "doc_id", "text", (F.size("pii") > 0).alias("changed"), count("email").alias("n_email"), count("phone", "abroad").alias("n_phone"),
        count("card").alias("n_card"), count("ip").alias("n_ip"), count("ssn").alias("n_ssn"), count("date").alias("n_date"),
    )
