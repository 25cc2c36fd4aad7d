"""PII pseudonyms by keyed permutations within the format, in SQL functions alone.

Every value found is mapped by a Feistel network whose round function is keyed SHA-512, so equal values stay equal across
documents and the map can be undone with the key. Digits stay digits and letters keep their case; a card number keeps its
check digit valid, an address stays an address, a date stays a date in its own notation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 256, 288  # dates are permuted within 256 * 288 days

# fixed values: formats, in the order in which they are tried
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}+",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "dot_date": r"(?<![\d.])\d{2}\.\d{2}\.\d{4}(?![\d.])",
    "slash_date": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\d-])|(?<![\d-])\d{13,19}(?![\d-])|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])",
}
CHUNK = 256  # finds whose lengths are summed at once
PATTERN = "|".join(f"(?:{p})" for k, p in FORMATS.items() if k != "card") + "|(?:" + FORMATS["card"].replace(r"([ -]?)", r"(?<sep>[ -]?)").replace(r"\1", r"\k<sep>") + ")"
DATES = {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy", "slash_date": "MM/dd/yyyy"}


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), use), F.lit(1))


def _hash(key: str, kind: str, turn: Column | int, value: Column) -> Column:
    turn = turn if isinstance(turn, Column) else F.lit(turn)
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value), 512)


def _number(digest: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def _shifted(half: Column, digest: Column) -> Column:
    """half with each digit and letter moved on within its own class by the digest's bytes."""

    def one(i: Column, half: Column, digest: Column) -> Column:
        c = F.substr(half, i, F.lit(1))
        k = F.conv(F.substr(digest, F.pmod(i - 1, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(c)
        move = lambda low, n: F.chr(F.lit(low) + F.pmod(code - low + k, F.lit(n)))
        return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).otherwise(c)

    shift = lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x["h"])), lambda i: one(i, x["h"], x["d"])), "")
    return F.when(F.length(half) > 0, _let(F.struct(half.alias("h"), digest.alias("d")), shift)).otherwise("")


def permuted(value: Column, key: str, kind: str) -> Column:
    """Feistel network on a string: its halves shift each other in turn; other characters than 0-9, a-z, A-Z stay."""

    def halves(v: Column) -> Column:
        n = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substr(v, F.lit(1), n).alias("l"), F.substr(v, n + 1).alias("r"))

    def turn(h: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, _shifted(h["l"], _hash(key, kind, i, h["r"]))).otherwise(h["l"])
        right = F.when(i % 2 == 0, _shifted(h["r"], _hash(key, kind, i, h["l"]))).otherwise(h["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), _let(value, halves), turn, lambda h: F.concat(h["l"], h["r"]))


def _pair(high: Column, low: Column, n_high: int, n_low: int, key: str, kind: str) -> Column:
    """Feistel network on a pair of numbers below n_high and n_low, as struct(h, l)."""

    def turn(s: Column, i: Column) -> Column:
        h = F.when(i % 2 == 1, F.pmod(s["h"] + _number(_hash(key, kind, i, s["l"].cast("string"))), F.lit(n_high))).otherwise(s["h"])
        low = F.when(i % 2 == 0, F.pmod(s["l"] + _number(_hash(key, kind, i, s["h"].cast("string"))), F.lit(n_low))).otherwise(s["l"])
        return F.struct(h.cast("long").alias("h"), low.cast("long").alias("l"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(high.cast("long").alias("h"), low.cast("long").alias("l")), turn)


def _luhn_digit(body: Column) -> Column:
    """The check digit that makes body + digit valid."""

    def total(b: Column) -> Column:
        def add(so_far: Column, i: Column) -> Column:
            d = F.substr(b, F.length(b) + 1 - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
            return so_far + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.lit(0), add)

    return F.pmod(-_let(body, total), F.lit(10))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """digits put in place of shape's own."""

    def one(i: Column, d: Column) -> Column:
        c = F.substr(shape, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(d, F.length(_digits(F.substr(shape, F.lit(1), i))), F.lit(1))).otherwise(c)

    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: one(i, d)), ""))


def _card(v: Column, key: str) -> Column:
    body = _digits(v)
    body = F.substr(body, F.lit(1), F.length(body) - 1)
    full = _let(permuted(body, key, "card"), lambda new: F.concat(new, _luhn_digit(new).cast("string")))
    return _refilled(v, full)


def _card_ok(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(13, 19) & (_luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.substr(d, F.length(d), F.lit(1)).cast("int")) & ~d.rlike("^0+$")


def _address(v: Column, key: str) -> Column:
    o = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    new = _let(o, lambda o: _pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ipv4"))
    return _let(new, lambda p: F.concat_ws(".", F.floor(p["h"] / 256), p["h"] % 256, F.floor(p["l"] / 256), p["l"] % 256))


def _address_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda x: (x.cast("int") <= 255) & ((F.length(x) == 1) | ~x.startswith("0")))


def _day(v: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(v, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _date(v: Column, form: str, key: str) -> Column:
    day = _day(v, form)
    new = _let(day, lambda day: _pair(F.floor(day / DAYS_LOW), day % DAYS_LOW, DAYS_HIGH, DAYS_LOW, key, "date"))
    return _let(new, lambda p: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (p["h"] * DAYS_LOW + p["l"]).cast("int")), form))


def _email(v: Column, key: str) -> Column:
    local = F.substring_index(v, "@", 1)
    return F.concat(permuted(local, key, "email"), F.lit("@"), F.substring_index(v, "@", -1))


def _phone(v: Column, key: str) -> Column:
    """The country code stays."""
    code = F.when(v.startswith("+"), F.regexp_extract(v, r"^\+\d{1,3}?(?=[ .(-])|^\+", 0)).otherwise("")
    rest = F.substr(v, F.length(code) + 1)
    return F.concat(code, _refilled(rest, permuted(_digits(rest), key, "phone")))


def _ssn_ok(v: Column) -> Column:
    return ~v.rlike(r"^(000|666|9)|-00-|-0000$")


def _ssn(v: Column, key: str) -> Column:
    """The first valid number on the way of repeated permutation: a permutation of the valid numbers. One in nine steps
    is invalid, so 30 of them always are enough in practice."""
    step = lambda x: _refilled(x, permuted(_digits(x), key, "ssn"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(30)), step(v), lambda x, _: F.when(_ssn_ok(x), x).otherwise(step(x)))


def classified(v: Column) -> Column:
    """The format of a value that PATTERN matched, null where it isn't valid."""
    full = lambda k: v.rlike(f"^(?:{FORMATS[k]})$")
    kind = F.when(F.contains(v, F.lit("@")), F.lit("email"))
    for k, form in DATES.items():
        kind = kind.when(full(k), F.when(_day(v, form).between(0, DAYS_HIGH * DAYS_LOW - 1), F.lit(k)))
    kind = kind.when(full("ipv4"), F.when(_address_ok(v), F.lit("ipv4")))
    kind = kind.when(full("phone"), F.lit("phone"))
    kind = kind.when(full("ssn"), F.when(_ssn_ok(v), F.lit("ssn")))
    return kind.otherwise(F.when(_card_ok(v), F.lit("card")))


def pseudonym(v: Column, kind: Column, key: str) -> Column:
    out = F.when(kind == "email", _email(v, key)).when(kind == "ipv4", _address(v, key)).when(kind == "phone", _phone(v, key))
    for k, form in DATES.items():
        out = out.when(kind == k, _date(v, form, key))
    out = out.when(kind == "ssn", _ssn(v, key)).when(kind == "card", _card(v, key))
    return F.coalesce(out, v)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs with `text` rewritten and `pii` added: array of kind, start (code point in the old text), value's pseudonym.

    Valid values of the formats are replaced, all else stays as it is: numbers with a wrong check digit, days that don't
    exist and addresses with parts over 255 are no finds. A null text stays null with a null pii; texts without finds
    have an empty array. All other columns pass through; a column named pii is replaced. No shuffle, no Python.
    """
    text = F.col("text")
    own = [c for c in docs.columns if c != "pii"]
    likely = text.rlike("[0-9@]")
    hits = F.when(likely, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = docs.select(*own, hits.alias("__hits"))
    typed = F.transform("__hits", lambda v: F.struct(v.alias("v"), classified(v).alias("k")))
    found = found.withColumn("__hits", typed)
    found = found.withColumn("__hits", F.transform("__hits", lambda h: F.struct(h["v"].alias("v"), h["k"].alias("k"), pseudonym(h["v"], h["k"], key).alias("p"))))
    parts = F.when(F.size("__hits") > 0, F.split(text, PATTERN, -1))
    found = found.withColumn("__parts", parts)
    # places of finds: sums of lengths over whole chunks of finds, then within the chunk, so that texts of very many finds
    # don't sum all earlier parts again for each
    steps = F.transform("__hits", lambda h, i: F.length(F.get("__parts", i)) + F.length(h["v"]))
    found = found.withColumn("__steps", steps)
    total = lambda first, n: F.aggregate(F.slice("__steps", first, n), F.lit(0), lambda a, x: a + x)
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size("__steps") / CHUNK).cast("int")), lambda c: total(c * CHUNK + 1, F.lit(CHUNK)))
    found = found.withColumn("__chunks", F.when(F.size("__hits") > 0, chunks))
    chunk = lambda i: F.floor(i / CHUNK).cast("int")
    begin = lambda i: F.aggregate(F.slice("__chunks", F.lit(1), chunk(i)), F.lit(0), lambda a, x: a + x) + total(chunk(i) * CHUNK + 1, i % CHUNK) + F.length(F.get("__parts", i))
    spans = F.filter(F.transform("__hits", lambda h, i: F.struct(h["k"].alias("kind"), begin(i).cast("long").alias("start"), h["p"].alias("value"))), lambda s: s["kind"].isNotNull())
    new = F.array_join(F.transform("__parts", lambda x, i: F.concat(x, F.coalesce(F.get(F.col("__hits"), i)["p"], F.lit("")))), "")
    out = found.withColumn("pii", F.when(text.isNotNull(), F.when(F.size("__hits") > 0, spans).otherwise(F.array().cast("array<struct<kind:string,start:bigint,value:string>>"))))
    return out.withColumn("text", F.when(F.size("__hits") > 0, new).otherwise(text)).drop("__hits", "__parts", "__steps", "__chunks")
