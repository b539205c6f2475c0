"""Operator 5 (native): format-preserving Feistel pseudonyms for personal data and secrets.

One pattern finds candidates; numbers are validated (Luhn, IBAN mod 97, octets, calendar) and what is valid is replaced
by a keyed permutation within its own format: an alternating Feistel network whose halves are counted modulo m1 and m2,
with SHA-256 of key, format and half as the round function. A permutation has no collisions, so equal values stay linked
across documents and different values stay different. Texts without candidates come back as they are. Only built-in
expressions run; no shuffle is needed.

Kinds: e-mail (local part; the domain stays as it is), payment card (the check digit is computed anew), IBAN (country kept,
check digits anew), IPv4, telephone (country code kept), social security number (permuted among the valid ones), dates from
1900 to 2099 (ISO and two slash or dot forms, permuted among the days of these years), cloud access keys, and values
assigned to password, token, secret or api key.

The key decides all: who has it can undo the pseudonyms. It comes from the setting ``KEY_SETTING``, which must be kept if
values are to stay linked between runs. Where it is unset one is drawn at random for the application, so values are linked
within it only. The key is part of the plan, so plans and event logs have to be kept as safe as the key.

Defined results: null texts stay null with 0 replacements; empty texts stay empty; rows are judged one by one, so ties and
repeated rows need no rule; an empty table stays empty; texts are read whole, of any length; other columns pass through,
whatever they are called, and a clashing ``n_pii`` is replaced.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import let, unused

KEY_SETTING = "spark.marlstone.pii.key"
ROUNDS = 10
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# Runs are bounded and begin where no character of their own kind stands before them, so scans stay linear.
EMAIL = "(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\\.[A-Za-z0-9-]{1,63}){1,8}"
ACCESS_KEY = "(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])"
ASSIGNED = '(?<![A-Za-z])(?i:password|passwd|pwd|token|secret|api[_-]?key)"?[ \\t]{0,3}[:=][ \\t]{0,3}["\']?[A-Za-z0-9_+/-]{8,128}'
# Length by country (ISO 13616), grouped by length; without a space or in blocks of four.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CR HR LI LV CH", 22: "BG BH DE GB GE IE ME RS",
    23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "(?<![A-Z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(
    f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{n - 4}}}|(?: [A-Z0-9]{{4}}){{{(n - 4) // 4}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''})" for n, c in _IBAN_LENGTHS.items()
) + ")(?![A-Z0-9])"
# One unbroken run, or 4-4-4-4 (of 19 digits with 3 more), 4-6-5 and 4-6-4; other groupings are left.
CARD = "(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3}(?![.-]?[0-9]))?|[ -][0-9]{6}[ -][0-9]{4,5}))(?![0-9])"
IPV4 = f"(?<![0-9.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9]|\\.[0-9])"
DATE = "(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}|[0-9]{2}\\.[0-9]{2}\\.(?:19|20)[0-9]{2})(?![0-9]|[/.-][0-9])"
SSN = "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
# A North American layout is tried first; elsewhere no group may begin a dotted quad, a date or a number of four groups.
_NEXT = f"(?![ .-]?(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9])|[ .-][0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(?![0-9])|[ .-][0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}|[ .][0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![0-9])|[ .](?:[0-9]{{3}}-){{2}}[0-9]{{4}}(?![0-9]))"
_NO_CARD = "(?![ .-](?:[0-9]{4}[ -]){3}[0-9]{4}|[ .-][0-9]{4}[ -][0-9]{6}[ -])"
_NANP = "\\+1[ .-]?(?:\\([0-9]{3}\\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"
_ABROAD = f"\\+[1-9][0-9]{{0,2}}[ .-]?(?:\\([0-9]{{2,4}}\\)|[0-9]{{2,4}})(?:{_NEXT}[ .-]?[0-9]{{2,4}}){{2}}(?:{_NEXT}{_NO_CARD}[ .-]?[0-9]{{2,4}}){{0,2}}"
PHONE = f"(?<![0-9+])(?:{_NANP}|{_ABROAD}|\\([0-9]{{3}}\\) ?[0-9]{{3}}-[0-9]{{4}}|[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}})(?![0-9])"
KINDS = {"email": EMAIL, "access_key": ACCESS_KEY, "assigned": ASSIGNED, "iban": IBAN, "ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
CANDIDATE = "|".join(KINDS.values())
#: What every candidate holds: a digit, or an at sign, colon or equals sign, or the beginning of an access key.
GATE = "[0-9@:=]|A[KS]IA"

DAY_ZERO = "1900-01-01"
#: Their product is the number of days from 1900 to 2099.
DATE_HALVES = (17, 4297)
#: Social security numbers: 898 areas (not 000, 666 or from 900 on) of 99 groups, and 9999 serials.
SSN_HALVES = (898 * 99, 9999)
_KEYS: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key of KEY_SETTING, or one drawn for this application."""
    found = spark.conf.get(KEY_SETTING, None)
    return found or _KEYS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def feistel(x: Column, m1: Column, m2: Column, tweak: Column, key: str) -> Column:
    """A keyed permutation of 0 .. m1 * m2 - 1 (both halves and the product fit a long)."""

    def round_value(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        a, b = s["a"], s["b"]
        return F.when(
            i % 2 == 1, F.struct(((a + F.pmod(round_value(i, b), s["m1"])) % s["m1"]).alias("a"), b.alias("b"), s["m1"].alias("m1"), s["m2"].alias("m2"))
        ).otherwise(F.struct(a.alias("a"), ((b + F.pmod(round_value(i, a), s["m2"])) % s["m2"]).alias("b"), s["m1"].alias("m1"), s["m2"].alias("m2")))

    start = let(x, lambda v: F.struct(F.call_function("div", v, m2).alias("a"), (v % m2).alias("b"), m1.cast("long").alias("m1"), m2.cast("long").alias("m2")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["a"] * s["m2"] + s["b"])


_RADIX = {"0123456789": (10, 17), "0123456789abcdef": (16, 14), "abcdefghijklmnopqrstuvwxyz": (26, 12), "ABCDEFGHIJKLMNOPQRSTUVWXYZ": (26, 12)}
_CONV = "0123456789abcdefghijklmnop"


def permute_symbols(symbols: Column, alphabet: str, tweak: Column, key: str) -> Column:
    """A string over ``alphabet`` to another of its length, in blocks whose values fit a long."""
    radix, block = _RADIX[alphabet]

    def one(part: Column, at: Column) -> Column:
        n = F.length(part)
        low = F.floor(n / 2)
        powers = F.array(*[F.lit(radix**k) for k in range(block // 2 + 2)])
        m2 = F.get(powers, low.cast("int"))
        m1 = F.get(powers, (n - low).cast("int"))
        value = F.conv(F.translate(part, alphabet, _CONV[:radix]), radix, 10).cast("long")
        t = F.concat_ws("/", tweak, F.lit(alphabet[:1]), n.cast("string"), at.cast("string"))
        out = F.lower(F.conv(feistel(value, m1, m2, t, key).cast("string"), 10, radix))
        return F.translate(F.lpad(out, n, "0"), _CONV[:radix], alphabet)

    starts = F.when(F.length(symbols) > 0, F.sequence(F.lit(1), F.length(symbols), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(starts, lambda p: let(F.substring(symbols, p, F.lit(block)), lambda part: one(part, p))), "")


def only(text: Column, keep: str) -> Column:
    return F.regexp_replace(text, f"[^{keep}]", "")


def refill(shape: Column, digits: Column, lower: Column | None = None, upper: Column | None = None) -> Column:
    """``shape`` with its digits and letters replaced, in order, by those given."""

    def char(i: Column) -> Column:
        head = F.substring(shape, F.lit(1), i)
        c = F.substring(shape, i, F.lit(1))
        out = F.when(c.rlike("[0-9]"), F.substring(digits, F.length(only(head, "0-9")), F.lit(1)))
        if lower is not None:
            out = out.when(c.rlike("[a-z]"), F.substring(lower, F.length(only(head, "a-z")), F.lit(1)))
        if upper is not None:
            out = out.when(c.rlike("[A-Z]"), F.substring(upper, F.length(only(head, "A-Z")), F.lit(1)))
        return out.otherwise(c)

    return F.when(F.length(shape) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), char), "")).otherwise(shape)


def permute_mixed(value: Column, kind: str, key: str) -> Column:
    """Digits, lower-case and upper-case letters of ``value`` permuted each in its own alphabet, all else kept."""

    def body(v: Column) -> Column:
        shape = F.concat_ws(":", F.lit(kind), F.translate(F.translate(F.translate(v, "0123456789", "9" * 10), "abcdefghijklmnopqrstuvwxyz", "a" * 26), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26))
        # each alphabet's permutation also depends on what the others hold, so short parts still spread
        lower = permute_symbols(only(v, "a-z"), "abcdefghijklmnopqrstuvwxyz", F.concat_ws("~", shape, only(v, "0-9"), only(v, "A-Z")), key)
        upper = lambda low: permute_symbols(only(v, "A-Z"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.concat_ws("~", shape, only(v, "0-9"), low), key)
        digits = lambda low, up: permute_symbols(only(v, "0-9"), "0123456789", F.concat_ws("~", shape, low, up), key)
        return let(lower, lambda low: let(upper(low), lambda up: let(digits(low, up), lambda d: refill(v, d, low, up))))

    return let(value, body)


def luhn_sum(digits: Column, first_weight_from_right: int) -> Column:
    """Sum of digits with every second doubled; the rightmost has the weight given."""

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = (F.length(digits) - i + (first_weight_from_right - 1)) % 2 == 1
        return F.when(doubled, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, b: a + b)


def mod97(text: Column) -> Column:
    """Remainder by 97 of digits and letters (A is 10) read as one number."""

    def step(a: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)

    return F.aggregate(F.array_remove(F.split(text, ""), ""), F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def replaced(part: Column, d: Column) -> Column:
        head = F.substring(d, F.lit(1), F.length(d) - 1)
        # 18 digits at most: two blocks where there are more than 17
        fresh = permute_symbols(head, "0123456789", F.concat(F.lit("card"), F.length(d).cast("string")), key)
        return let(fresh, lambda f: refill(part, F.concat(f, F.pmod(-luhn_sum(f, 2), F.lit(10)).cast("string"))))

    def valid(part: Column, otherwise: Column) -> Column:
        return let(only(part, "0-9"), lambda d: F.when(luhn_sum(d, 1) % 10 == 0, replaced(part, d)).otherwise(otherwise))

    # of 4-4-4-4-3 that is no card the first four groups may be one, with a number after it
    head, tail = F.substring(m, 1, 19), F.substring(m, F.lit(20), F.length(m))
    return valid(m, F.when(m.rlike("^.{4}[ -].{4}[ -].{4}[ -].{4}[ -]"), F.concat(valid(head, head), tail)).otherwise(m))


def _ipv4(m: Column, key: str) -> Column:
    def body(o: Column) -> Column:
        n = F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        half = F.lit(65536).cast("long")
        return let(
            feistel(n, half, half, F.lit("ipv4"), key),
            lambda x: F.concat_ws(".", *[F.shiftrightunsigned(x, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]),
        )

    return let(F.split(m, "\\."), body)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, "^\\+[0-9]{1,3}", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return let(rest, lambda r: F.concat(code, refill(r, permute_symbols(only(r, "0-9"), "0123456789", F.lit("phone"), key))))


def _iban(m: Column, key: str) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    valid = mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1

    def body(b: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(b, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return refill(m, F.concat(check, only(b, "0-9")), None, F.concat(F.substring(m, 1, 2), only(b, "A-Z")))

    return F.when(valid, let(permute_mixed(F.substring(flat, F.lit(5), F.length(flat)), "iban", key), body)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    iso, slash, dot = m.rlike("^....-"), m.rlike("/"), m.rlike("\\.")
    day = F.coalesce(
        F.when(iso, F.try_to_date(m, "yyyy-MM-dd")),
        F.when(slash, F.coalesce(F.try_to_date(m, "MM/dd/yyyy"), F.try_to_date(m, "dd/MM/yyyy"))),
        F.when(dot, F.try_to_date(m, "dd.MM.yyyy")),
    )
    a, b = DATE_HALVES

    def body(offset: Column) -> Column:
        fresh = feistel(offset.cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit("date"), key)
        out = F.date_add(F.lit(DAY_ZERO).cast("date"), fresh.cast("int"))
        slashed = F.when(F.try_to_date(m, "MM/dd/yyyy").isNotNull(), F.date_format(out, "MM/dd/yyyy")).otherwise(F.date_format(out, "dd/MM/yyyy"))
        return F.when(iso, F.date_format(out, "yyyy-MM-dd")).when(dot, F.date_format(out, "dd.MM.yyyy")).otherwise(slashed)

    return F.when(day.isNull(), m).otherwise(let(F.datediff(day, F.lit(DAY_ZERO).cast("date")), body))


def _ssn(m: Column, key: str) -> Column:
    """Area, group and serial counted among the valid ones, permuted, and written again."""
    part = lambda at, n: F.substring(m, at, n).cast("long")
    area = part(1, 3)
    a, b = SSN_HALVES
    rank = ((area - 1 - (area > 666).cast("long")) * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1

    def body(x: Column) -> Column:
        whole = F.call_function("div", x, F.lit(9999))
        fresh = F.call_function("div", whole, F.lit(99)) + 1
        return F.concat_ws("-", F.lpad((fresh + (fresh >= 666).cast("long")).cast("string"), 3, "0"), F.lpad((whole % 99 + 1).cast("string"), 2, "0"), F.lpad((x % 9999 + 1).cast("string"), 4, "0"))

    return let(feistel(rank, F.lit(a).cast("long"), F.lit(b).cast("long"), F.lit("ssn"), key), body)


def _assigned(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, "[A-Za-z0-9_+/-]+$", 0)

    def body(v: Column) -> Column:
        head = F.substring(m, F.lit(1), F.length(m) - F.length(v))
        is_hex = v.rlike("^[0-9a-f]+$") & v.rlike("[a-f]")
        as_hex = permute_symbols(v, "0123456789abcdef", F.lit("hex"), key)
        return F.concat(head, F.when(is_hex, as_hex).otherwise(permute_mixed(v, "assigned", key)))

    return let(value, body)


def pseudonym(m: Column, key: str) -> Column:
    """The replacement of one candidate; a candidate that is not valid comes back as it is."""
    at = F.instr(m, "@")
    whole = lambda pattern: m.rlike(f"^(?:{pattern})$")
    email = F.concat(permute_mixed(F.substring(m, F.lit(1), at - 1), "email", key), F.substring(m, at, F.length(m)))
    access = F.concat(F.substring(m, 1, 4), permute_mixed(F.substring(m, F.lit(5), F.length(m)), "access", key))
    return (
        F.when(whole(EMAIL), email)
        .when(whole(ACCESS_KEY), access)
        .when(whole(ASSIGNED), _assigned(m, key))
        .when(whole(IPV4), _ipv4(m, key))
        .when(whole(DATE), _date(m, key))
        .when(whole(SSN), _ssn(m, key))
        .when(whole(PHONE), _phone(m, key))
        .when(whole(CARD), _card(m, key))
        .when(whole(IBAN), _iban(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced and ``n_pii``, the number of values that changed; ``key``: by default ``key_of``."""
    key = key or key_of(docs.sparkSession)

    def rebuild(found: Column) -> Column:
        gaps = F.split(F.col(text), CANDIDATE, -1)
        fresh = F.transform(found, lambda m: pseudonym(m, key))

        return let(
            gaps,
            lambda g: let(
                fresh,
                lambda f: F.struct(
                    F.concat(F.array_join(F.transform(f, lambda x, i: F.concat(F.get(g, i), x)), ""), F.element_at(g, -1)).alias("text"),
                    F.size(F.filter(F.zip_with(found, f, lambda a, b: a != b), lambda x: x)).alias("n"),
                ),
            ),
        )

    found = F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))
    same = F.struct(F.col(text).alias("text"), F.lit(0).alias("n"))
    out = docs.drop("n_pii")
    made = unused("fresh", out.columns)
    # texts without the gate's characters, null ones among them, are not searched
    fresh = F.when(F.col(text).rlike(GATE), let(found, lambda m: F.when(F.size(m) == 0, same).otherwise(rebuild(m)))).otherwise(same)
    return out.withColumn(made, fresh).select(*[F.col(f"{made}.text").alias(c) if c == text else c for c in out.columns], F.col(f"{made}.n").alias("n_pii"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)
