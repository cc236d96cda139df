"""Format-preserving Feistel pseudonyms for validated numbers and dates, DataFrame functions only.

Card numbers (Luhn), phone numbers, social security numbers (issued areas, groups and serials), IPv4 addresses and ISO
dates (1900-01-01 to 2079-06-06, which are 256 x 256 days; others are no hits) are permuted under a key within their own
format, so equal values stay equal across documents, different ones differ and valid values stay valid. Phone numbers
keep their country prefix, or without one the first digit. Cards keep length and separators and get a fresh Luhn digit. E-mail addresses, which have no numeric domain,
get a keyed local part. Cards are sought in every span of whole digit groups of a longer run. Null text stays null, a null doc_id
stays null; texts without matches, empty and repeated ones are returned as they are; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 6
DATE = r"(?:19\d\d|20[0-7]\d)-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
CARD = r"\d(?:[ -]?\d){12,18}"
SSN = r"\d{3}-\d{2}-\d{4}"
#: Groups of digits joined by single spaces and hyphens, 13 digits at least; possessive, so long runs need no stack.
GROUPS = r"\d++(?:-\d++)*+(?![\w-]|\.\d)"
RUN = rf"(?=\d(?:[ -]?\d){{12}}){GROUPS}(?: {GROUPS})*+"
#: Without a country prefix: area code from 200 on, in brackets or followed by a point or hyphen.
LOCAL = r"(?:\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[.-])\d{3}[ .-]?\d{4}"
PHONE = rf"\+?\d{{1,3}}[ .-]?\(\d{{3}}\)[ .-]?\d{{3}}[ .-]?\d{{4}}|\+\d(?:[ .-]?\d){{8,13}}|{LOCAL}"
IP = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
ANY = rf"{EMAIL}|(?<![\w.-])(?:{DATE}|{SSN}|{IP}|{RUN}|{PHONE})(?![\w-]|\.\d)"


def mix(key: str, tag: Column, k: int, half: Column) -> Column:
    """Round function: 60 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tag, F.lit(str(k)), half.cast("string")), 256), 1, 15), 16, 10).cast("long")


def tied(value: Column, use) -> Column:
    """value bound once, so that rounds do not copy each other's expressions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def turn(k: int, m_left: Column, m_right: Column, key: str, tag: Column):
    if k % 2:
        return lambda p: F.struct(p["a"].alias("a"), F.pmod(p["b"] + mix(key, tag, k, p["a"]), m_right).alias("b"))
    return lambda p: F.struct(F.pmod(p["a"] + mix(key, tag, k, p["b"]), m_left).alias("a"), p["b"].alias("b"))


def feistel(left: Column, right: Column, m_left: Column, m_right: Column, key: str, tag: Column) -> Column:
    """struct(a, b): a permutation of pairs below m_left and m_right by alternating additions."""
    x = F.struct(left.alias("a"), right.alias("b"))
    for k in range(ROUNDS):
        x = tied(x, turn(k, m_left, m_right, key, tag))
    return x


def permute_digits(digits: Column, key: str, tag: str) -> Column:
    """A digit string (2 to 18 digits) permuted among those of its length."""
    n = F.length(digits)
    cut = F.floor(n / 2).cast("int")
    power = lambda e: F.pow(F.lit(10.0), e).cast("long")
    out = feistel(F.substring(digits, F.lit(1), cut).cast("long"), F.substring(digits, cut + 1, n).cast("long"), power(cut), power(n - cut), key, F.concat(F.lit(tag), n.cast("string")))
    return tied(out, lambda p: F.concat(F.lpad(p["a"].cast("string"), cut, "0"), F.lpad(p["b"].cast("string"), n - cut, "0")))


def luhn_sum(digits: Column, odd: int) -> Column:
    """Luhn sum; digits at places of parity `odd` from the right are doubled."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + tied(F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == odd, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))


def refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits replaced in turn."""
    places = F.sequence(F.lit(1), F.length(shape))
    return F.array_join(F.transform(places, lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), "")


def only(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def kind_of(hit: Column) -> Column:
    full = lambda p: hit.rlike(f"^(?:{p})$")
    return (
        F.when(hit.contains("@"), "email").when(full(DATE), F.when(F.try_to_date(hit, "yyyy-MM-dd").between(F.lit("1900-01-01").cast("date"), F.lit("2079-06-06").cast("date")), "date"))
        .when(full(SSN), F.when(hit.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)"), "ssn")).when(full(IP), "ip").when(full(CARD) & (luhn_sum(only(hit), 1) % 10 == 0), "card").when(full(PHONE), "phone")
    )


def parts(hit: Column) -> Column:
    """The hit in parts that join to it. A run of digit groups is cut at the cards in it: of all spans of whole groups with
    13 to 19 digits that pass Luhn, single groups first, then the usual shapes, then the longest, none overlapping."""

    def cards(g: Column) -> Column:
        span = lambda i, n: F.array_join(F.slice(g, i, n), "")
        body = lambda i, n: F.regexp_replace(span(i, n), "[ -]$", "")
        spans = F.flatten(F.transform(F.sequence(F.lit(1), F.size(g)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(g) - i + 1)), lambda n: F.struct(i.alias("i"), n.alias("n"), body(i, n).alias("s")))))
        valid = F.filter(spans, lambda x: F.length(only(x["s"])).between(13, 19) & (luhn_sum(only(x["s"]), 1) % 10 == 0))
        usual = lambda x: x["s"].rlike(r"^(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5})$")
        ranked = F.array_sort(F.transform(valid, lambda x: F.struct(F.when(x["n"] == 1, 0).when(usual(x), 1).otherwise(2).alias("rank"), (-F.length(only(x["s"]))).alias("short"), x["i"].alias("i"), x["n"].alias("n"))))
        place = lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"))
        free = lambda done, x: ~F.exists(done, lambda c: (c["i"] < x["i"] + x["n"]) & (x["i"] < c["i"] + c["n"]))
        return F.array_sort(F.aggregate(ranked, F.array().cast("array<struct<i:int,n:int>>"), lambda done, x: F.when(free(done, x), F.concat(done, F.array(place(x)))).otherwise(done)))

    def cut(g: Column, c: Column) -> Column:
        ends = F.concat(c, F.array(F.struct((F.size(g) + 1).alias("i"), F.lit(0).alias("n"))))
        before = lambda k: F.when(k == 0, 1).otherwise(F.try_element_at(c, k)["i"] + F.try_element_at(c, k)["n"])
        rest = lambda k, x: F.array_join(F.slice(g, before(k), x["i"] - before(k)), "")
        card = lambda x: F.array_join(F.slice(g, x["i"], x["n"]), "")
        plain = lambda k, x: F.regexp_extract_all(rest(k, x), F.lit("([^ ]+| )"), F.lit(1))
        split = lambda x: F.array(F.regexp_replace(card(x), "[ -]$", ""), F.regexp_extract(card(x), "[ -]?$", 0))
        return F.flatten(F.transform(ends, lambda x, k: F.concat(plain(k, x), split(x))))

    groups = F.regexp_extract_all(hit, F.lit(r"([0-9]+[ -]?)"), F.lit(1))
    return F.when(hit.rlike(f"^(?:{RUN})$") & hit.rlike("[ -]"), tied(groups, lambda g: tied(cards(g), lambda c: cut(g, c)))).otherwise(F.array(hit))


def full_local(hit: Column) -> Column:
    return hit.rlike(f"^(?:{LOCAL})$")


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(hit, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).cast("long")
    two = F.lit(256).cast("long")
    date = tied(feistel(F.floor(day / 256), day % 256, two, two, key, F.lit("date")), lambda p: F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * 256 + p["b"]).cast("int")), "yyyy-MM-dd"))
    octet = lambda i: F.try_element_at(F.split(hit, r"\."), F.lit(i)).cast("long")
    wide = F.lit(65536).cast("long")
    ip = tied(feistel(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), wide, wide, key, F.lit("ip")), lambda p: F.concat_ws(".", *(x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))))
    body = permute_digits(F.substring(only(hit), F.lit(1), F.length(only(hit)) - 1), key, "card")
    card = tied(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
    # Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999.
    area = F.substring(hit, 1, 3).cast("long")
    rest = (F.substring(hit, 5, 2).cast("long") - 1) * 9999 + F.substring(hit, 8, 4).cast("long") - 1
    number = lambda p: F.format_string("%03d-%02d-%04d", p["a"] + 1 + (p["a"] >= 665).cast("long"), F.floor(p["b"] / 9999) + 1, p["b"] % 9999 + 1)
    ssn = tied(feistel(area - 1 - (area > 666).cast("long"), rest, F.lit(898).cast("long"), F.lit(99 * 9999).cast("long"), key, F.lit("ssn")), number)
    # A country prefix stays; else the first digit, which tells valid area codes.
    lead = F.regexp_extract(hit, r"^\+?([0-9]{1,3})(?![0-9])", 1)
    held = F.when(full_local(hit), 1).when(F.length(lead) > 0, F.length(lead)).otherwise(2)
    phone = F.concat(F.substring(only(hit), F.lit(1), held), permute_digits(F.substring(only(hit), held + 1, F.length(only(hit))), key, "phone"))
    mail = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(hit)), 256), 1, 12), F.lit("@"), F.substring_index(hit, "@", -1))
    return (
        F.when(kind == "date", date).when(kind == "ip", ip).when(kind == "card", refill(hit, card)).when(kind == "ssn", ssn)
        .when(kind == "phone", refill(hit, phone)).when(kind == "email", mail).otherwise(hit)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_found, kinds."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = df.withColumn("hits", F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("each", F.transform("hits", lambda h: F.transform(parts(h), lambda p: F.struct(p.alias("hit"), kind_of(p).alias("kind")))))
    df = df.withColumn("found", F.flatten("each"))
    df = df.withColumn("swap", F.transform("each", lambda e: F.array_join(F.transform(e, lambda x: pseudonym(x["hit"], x["kind"], key)), "")))
    new = F.array_join(F.flatten(F.zip_with(F.split("text", ANY, -1), "swap", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return df.select("doc_id", F.when(F.size("hits") > 0, new).otherwise(F.col("text")).alias("text"), F.expr("cast(size(filter(found, x -> x.kind is not null)) as bigint)").alias("n_found"), F.expr("array_join(array_sort(array_distinct(filter(transform(found, x -> x.kind), k -> k is not null))), ',')").alias("kinds"))
