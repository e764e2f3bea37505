r"""Pseudonyms for personal data that keep its format, by keyed Feistel networks over digits, addresses and dates.

A value found in a text is validated (checksum, calendar, ranges), then permuted by a key within the set of values of
its format: the same value gets the same pseudonym in every document, different values get different ones, and the
pseudonym passes the validation again. Punctuation and width stay. Everything is a Spark SQL expression without state,
so there is no shuffle. E-mail addresses and secrets, which are no numbers, have each letter and digit of their local
part or value shifted within its class by a keyed digest of the whole value; they stay linked too, but are no permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: For tests only: whoever knows the key can undo the permutations. Sessions name their own in KEY_SETTING.
DEFAULT_KEY = "quillmap-pseudonyms"
KEY_SETTING = "spark.quillmap.pseudonymKey"
ROUNDS = 8
#: Cycle walking stops after so many steps; less than one value in 10**15 would need more.
WALKS = 24
#: Days from 1900-01-01 to 2099-12-31, and the side of the square that the Feistel network permutes them in.
DAYS, SIDE = 73049, 271

#: Formats of personal data, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<=(?:[Tt]oken|TOKEN|[Kk]ey|KEY|[Ss]ecret|SECRET|[Pp]assword|PASSWORD)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{16,}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "iso_date": r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "date": r"(?<![\d./-])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d/]|\.\d)",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
}
#: Back-references are numbered within the whole pattern: date's separator is its only group.
ANY = "|".join(PATTERNS.values())
#: Issuer prefixes of payment cards with the number of digits.
CARD = r"^(?:4\d{12}(?:\d{3}(?:\d{3})?)?|5[1-5]\d{14}|2(?:2[2-9]|[3-6]\d|7[01])\d{13}|2720\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d\d|4[4-9]\d)\d{12}|35(?:2[89]|[3-8]\d)\d{12})$"


def _once(value: Column, then) -> Column:
    """then(value) with value computed once, inside a lambda too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _noise(key: str, *parts: Column) -> Column:
    """A keyed number of 60 bits from the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, tag: str, inverse: bool = False) -> Column:
    """Permute the pair (left < a, right < b) of longs: each round adds a keyed function of one half to the other."""

    def step(acc, i):
        l, r, even = acc["l"], acc["r"], i % 2 == 0
        noise = _noise(key, F.lit(tag), a, b, i, F.when(even, r).otherwise(l))
        sign = F.lit(-1 if inverse else 1)
        return F.struct(F.when(even, F.pmod(l + sign * F.pmod(noise, a), a)).otherwise(l).alias("l"), F.when(even, r).otherwise(F.pmod(r + sign * F.pmod(noise, b), b)).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_digits(digits: Column, key: str, tag: str, inverse: bool = False) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36."""

    def of(s):
        n = F.char_length(s)
        h = F.floor(n / 2).cast("int")
        ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
        pair = feistel(F.substr(s, F.lit(1), h).cast("long"), F.substr(s, h + 1).cast("long"), ten(h), ten(n - h), key, tag, inverse)
        return _once(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), h, "0"), F.lpad(p["r"].cast("string"), n - h, "0")))

    return _once(digits, of)


def _walk(value: Column, permute, valid) -> Column:
    """Cycle walking: permute until the value is valid; it begins valid, so the walk is a permutation of the valid ones."""
    start = F.struct(permute(value).alias("v"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), start, lambda acc, _: F.when(valid(acc["v"]), acc).otherwise(F.struct(permute(acc["v"]).alias("v"))), lambda acc: acc["v"])


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced by the given ones, one by one."""
    return F.aggregate(
        F.split(shape, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc["out"], F.substr(digits, acc["at"], F.lit(1))).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))
        ),
        lambda acc: acc["out"],
    )


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; from the right, digits at positions of the parity `doubled` count double."""
    reversed_digits = F.split(F.reverse(digits), "")
    each = F.transform(reversed_digits, lambda c, i: _once(c.cast("int") * F.when(i % 2 == doubled, 2).otherwise(1), lambda v: v - F.when(v > 9, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + v)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _card_valid(m: Column) -> Column:
    return _once(_digits(m), lambda d: d.rlike(CARD) & (_luhn_sum(d, 1) % 10 == 0))


def _card(m: Column, key: str) -> Column:
    """The issuer's first four digits stay, the check digit is computed anew."""

    def of(d):
        n = F.char_length(d)
        body = F.concat(F.substr(d, F.lit(1), F.lit(4)), permute_digits(F.substr(d, F.lit(5), n - 5), key, "card"))
        return _once(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(b, 0) % 10, F.lit(10)).cast("string")))

    return _refill(m, _once(_digits(m), of))


def _phone(m: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(m, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    rest = F.substr(m, F.char_length(code) + 1)
    return F.concat(code, _refill(rest, permute_digits(_digits(rest), key, "phone")))


def _ssn_valid(d: Column) -> Column:
    return d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _ssn(m: Column, key: str) -> Column:
    return _refill(m, _walk(_digits(m), lambda d: permute_digits(d, key, "ssn"), _ssn_valid))


def _ip_parts(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda p: p.cast("long"))


def _ip_valid(m: Column) -> Column:
    return F.forall(_ip_parts(m), lambda p: p <= 255)


def _ip(m: Column, key: str) -> Column:
    def of(p):
        side = F.lit(65536).cast("long")
        pair = feistel(F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1)), F.get(p, F.lit(2)) * 256 + F.get(p, F.lit(3)), side, side, key, "ip")
        return _once(pair, lambda q: F.concat_ws(".", F.floor(q["l"] / 256), q["l"] % 256, F.floor(q["r"] / 256), q["r"] % 256))

    return _once(_ip_parts(m), of)


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit("1900-01-01").cast("date")).cast("long")


def _moved(day: Column, key: str) -> Column:
    side = F.lit(SIDE).cast("long")
    permute = lambda d: _once(feistel(F.floor(d / SIDE), d % SIDE, side, side, key, "date"), lambda p: p["l"] * SIDE + p["r"])
    return F.date_add(F.lit("1900-01-01").cast("date"), _walk(day, permute, lambda d: d < DAYS).cast("int"))


def _iso(m: Column) -> Column:
    return F.try_to_date(m, "yyyy-MM-dd")


def _dmy(m: Column) -> Column:
    """Day first, or month first where only that is a date."""
    p = lambda k: F.lpad(F.get(F.split(m, "[./]"), F.lit(k)), 2, "0")
    year = F.get(F.split(m, "[./]"), F.lit(2))
    return F.coalesce(F.try_to_date(F.concat_ws("-", year, p(1), p(0)), "yyyy-MM-dd"), F.try_to_date(F.concat_ws("-", year, p(0), p(1)), "yyyy-MM-dd"))


def _in_range(date: Column) -> Column:
    return F.coalesce(date.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), F.lit(False))


def _date(m: Column, key: str) -> Column:
    """Day and month keep their order and width."""
    sep = F.regexp_extract(m, "[./]", 0)
    first = F.get(F.split(m, "[./]"), F.lit(0))
    second = F.get(F.split(m, "[./]"), F.lit(1))
    month_first = (first.cast("int") <= 12) & (second.cast("int") > 12)

    def of(d):
        padded = (F.char_length(first) == 2) & (F.char_length(second) == 2)
        show = lambda x: F.when(padded, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
        day, month = show(F.dayofmonth(d)), show(F.month(d))
        return F.concat(F.when(month_first, month).otherwise(day), sep, F.when(month_first, day).otherwise(month), sep, F.year(d).cast("string"))

    return _once(_moved(_day(_dmy(m)), key), of)


def _shifted(value: Column, whole: Column, key: str, tag: str) -> Column:
    """Each letter and digit of value moved within its class by a keyed digest of whole, never by nothing; a hexadecimal value stays one."""
    noise = lambda block: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), block.cast("string"), whole), 256)

    def of(blocks):
        def move(c, i):
            nib = F.conv(F.substr(F.get(blocks, F.floor(i / 16).cast("int")), (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")

            def within(low, n):
                return F.char(F.lit(ord(low)) + F.pmod(F.ascii(c) - ord(low) + 1 + F.pmod(nib, F.lit(n - 1)), F.lit(n)))

            hexadecimal = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
            letter = lambda low: F.when(hexadecimal, within(low, 6)).otherwise(within(low, 26))
            return F.when(c.rlike("^[a-z]$"), letter("a")).when(c.rlike("^[A-Z]$"), letter("A")).when(c.rlike("^[0-9]$"), within("0", 10)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), move), "")

    return _once(F.transform(F.sequence(F.lit(0), F.floor(F.char_length(value) / 16).cast("int")), noise), of)


def _email(m: Column, key: str) -> Column:
    """The domain stays."""
    local = F.regexp_extract(m, "^[^@]*", 0)
    return F.concat(_shifted(local, F.lower(m), key, "email"), F.substr(m, F.char_length(local) + 1))


def pseudonym(m: Column, key: str = DEFAULT_KEY) -> Column:
    """The pseudonym of one found value, or the value itself if it fails validation."""
    full = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return (
        F.when(full("email"), _email(m, key))
        .when(full("iso_date"), F.when(_in_range(_iso(m)), _once(_moved(_day(_iso(m)), key), lambda d: F.date_format(d, "yyyy-MM-dd"))).otherwise(m))
        .when(full("date"), F.when(_in_range(_dmy(m)), _date(m, key)).otherwise(m))
        .when(full("ip"), F.when(_ip_valid(m), _ip(m, key)).otherwise(m))
        .when(full("phone"), _phone(m, key))
        .when(full("ssn"), F.when(_ssn_valid(_digits(m)), _ssn(m, key)).otherwise(m))
        .when(full("card"), F.when(_card_valid(m), _card(m, key)).otherwise(m))
        .otherwise(_shifted(m, m, key, "secret"))
    )


def key_of(spark: SparkSession) -> str:
    """The key that the session's setting KEY_SETTING holds, or the public one."""
    return spark.conf.get(KEY_SETTING, None) or DEFAULT_KEY


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """docs with text_col pseudonymised and n_found (validated values replaced) added; a column n_found is replaced.

    The whole text is searched. Null texts stay null and empty ones empty, with n_found 0; ids play no part, so null
    and repeated rows are like all others; an empty table gives no rows. A value that fails its validation stays.
    Without a key, that of the session is taken; see key_of().
    """
    key = key or key_of(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() != "n_found"]
    text = F.col("__text")
    found = F.when(text.rlike("[0-9@]|(?i:token|key|secret|password)"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(text_col).alias("__text"))
    # F.transform over one element keeps each value's pseudonym from being computed again for each of its uses.
    rows = rows.withColumn("__new", F.when(text.isNotNull(), _once(found, lambda ms: F.transform(ms, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))))
    rows = rows.withColumn("__n", F.size(F.filter("__new", lambda x: x["m"] != x["p"])))
    spliced = _once(F.split(text, ANY, -1), lambda ps: F.array_join(F.zip_with(ps, F.col("__new"), lambda piece, x: F.concat(piece, F.coalesce(x["p"], F.lit("")))), ""))
    new = F.when(F.coalesce(F.col("__n"), F.lit(0)) > 0, spliced).otherwise(text)
    count = F.greatest(F.coalesce(F.col("__n"), F.lit(0)), F.lit(0)).cast("long")
    kept = [F.col(f"__row.`{c}`").alias(c) if c != text_col else new.alias(c) for c in names]
    return rows.select(*kept, count.alias("n_found"))
