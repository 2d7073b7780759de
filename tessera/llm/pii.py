"""Surrogates for personal data; DataFrame functions only.

Detected: e-mail addresses, IBANs, payment card numbers, social security numbers, telephone numbers, IPv4 addresses, and
names after (or, in Chinese, before) a form of address. Each mention is cut into parts; a part's kind and normal form name an entity: case,
spaces and separators don't count, so all mentions of an entity, in every document, get one surrogate (coreference), which is
written in the format of each mention: its separators, its lengths and its upper and lower case. An e-mail's address and
domain, and a name's given and family names, are entities of their own, so "Mr. A B" and "Mr. B" still share B.

A surrogate comes from a keyed hash of the entity. It is of the same type: letters for letters and digits for digits, a
card keeps its first digit and a valid check digit stays valid, as do an IBAN's, with its country; a telephone number in international form
is one entity in all its spellings and keeps its country code; an address in a private range stays in that range, and a public one public; a given name is of the gender of the form of address, and names are in the script of the original.

Collision checks run over the table of distinct entities: two entities of a kind never get one surrogate, and no surrogate
is a form that occurs in the corpus. Losers try again with the next number in the hash, in rounds, until none is left;
later tries of names and addresses are longer. Numbers can't get longer: where the corpus holds more than an eighth of all numbers of a format (a
length, and a card's first digit), its numbers go through a keyed permutation of the format instead, which can't collide at any
density and leaves no number as it is; such a surrogate may be another entity's number.

The key comes from the caller, and enters by HMAC-SHA-256. Only texts with a mention are moved. Defined cases: null text stays null, empty
stays empty; rows with one id are documents of their own, and equal rows get equal results; a null doc_id is allowed; an empty
table gives no rows; extra columns stay with ``replace`` (one named n_entities or entities with an underscore added) and are
ignored by the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, free_name

MOST_ROUNDS = 40
#: Rounds of the permutation, and the share of a format's numbers from which on it is used.
FEISTEL, CROWDED = 10, 1 / 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){1,20}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9A-Za-z])[3-6][0-9](?:[ -]?[0-9]){11,17}(?![0-9A-Za-z])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"
MALE = "Mr|Herr|Señor|Sr|Monsieur|г-н|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|г-жа|госпожа"
NAME = rf"(?<![\p{{L}}-])(?:{MALE}|{FEMALE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?"
# Family names, of two signs and of one, that begin a Chinese name; country codes of telephone numbers.
TWO_SIGNS = "欧阳|司马|上官|诸葛|司徒|东方|独孤|南宫|夏侯|皇甫|尉迟|公孙|慕容|令狐|长孙|宇文"
ONE_SIGN = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚"
CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2}"
#: A known family name and up to two signs; without one in reach, up to four signs. What stands before a family name is not part of the name.
HAN = rf"(?=\p{{IsHan}})(?:(?:{TWO_SIGNS}|[{ONE_SIGN}])\p{{IsHan}}{{0,2}}?|[\p{{IsHan}}&&[^{ONE_SIGN}]]{{2,4}}?)(?:先生|女士)"
TYPES = {"email": EMAIL, "iban": IBAN, "card": CARD, "ssn": SSN, "phone": PHONE, "ip": IP, "name": NAME, "han": HAN}
ANY = "|".join(TYPES.values())

#: Syllables of surrogate names, by script: starts, and endings of given names by gender and of family names.
SYLLABLES = {
    "latin": (("ba", "ce", "da", "fe", "gi", "ha", "jo", "ka", "li", "ma", "ne", "o", "pa", "ro", "sa", "te", "vi", "wa", "ze", "ta"), {"given_m": ("ron", "mir", "lus", "bert"), "given_f": ("ria", "lina", "dora", "nelle"), "family": ("man", "vick", "sen", "rell")}),
    "cyrillic": (("ба", "ве", "га", "ди", "жа", "за", "ки", "ла", "ми", "но", "па", "ро", "са", "та", "фе", "ха"), {"given_m": ("рий", "слав", "мир", "тон"), "given_f": ("рия", "лина", "дора", "нна"), "family": ("нко", "дзе", "вич", "ук")}),
    "han": (("安", "白", "成", "丹", "方", "高", "海", "嘉", "康", "林", "明", "宁", "平", "青", "思", "文"), {"given_m": ("刚", "强", "军", "伟"), "given_f": ("芳", "娟", "丽", "婷"), "family": ("王", "李", "张", "刘")}),
}


def _type(mention: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TYPES.items()):
        # look-arounds see no neighbours here; the alternation has already chosen the earliest type that matches
        out = F.when(F.regexp_like(mention, F.lit(f"^(?:{pattern})$")), name).otherwise(out)
    return out


def _struct(kind: Column | str, norm: Column, form: Column, piece: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("kind"), norm.alias("norm"), form.alias("form"), piece.alias("piece"))


def parts(mention: Column, kind: Column) -> Column:
    """Array of (kind, norm, form, piece): pieces without a kind are kept as they are. form: what a surrogate replaces."""
    null = F.lit(None).cast("string")
    keep = lambda piece: _struct(null, null, null, piece)
    plain = lambda k, strip: F.array(_struct(k, *[F.lower(F.regexp_replace(mention, strip, ""))] * 2, mention))
    local, domain = F.substring_index(mention, "@", 1), F.substring_index(mention, "@", -1)
    email = F.array(_struct("email", F.lower(mention), F.lower(local), local), keep(F.lit("@")), _struct("domain", F.lower(domain), F.lower(domain), domain))
    code = country_code(mention)
    rest = F.substring(mention, F.char_length(code) + 1, F.char_length(mention))
    whole = F.concat(code, F.regexp_replace(rest, "[^0-9]", ""))  # the number in international form, where its code is known
    phone = F.array(keep(code), _struct("phone", whole, whole, rest))
    title = F.regexp_extract(mention, rf"^((?:{MALE}|{FEMALE})\.? )", 1)
    male = F.regexp_like(title, F.lit(rf"^(?:{MALE})\.? $"))
    words = F.split(F.substring(mention, F.char_length(title) + 1, F.char_length(mention)), " ")
    low = lambda i: F.lower(F.element_at(words, i))
    given = F.when(male, F.lit("given_m")).otherwise(F.lit("given_f"))
    family = _struct("family", low(-1), low(-1), F.element_at(words, -1))
    name = F.when(F.size(words) > 1, F.array(keep(title), _struct(given, low(1), low(1), F.element_at(words, 1)), keep(F.lit(" ")), family)).otherwise(F.array(keep(title), family))
    n = F.char_length(mention)
    two = F.regexp_like(mention, F.lit(f"^(?:{TWO_SIGNS})")) & (n >= 4)
    first = F.when(two, F.left(mention, F.lit(2))).otherwise(F.left(mention, F.lit(1)))
    own = F.substring(mention, F.char_length(first) + 1, n - 2 - F.char_length(first))
    of = F.when(F.right(mention, F.lit(2)) == "先生", F.lit("given_m")).otherwise(F.lit("given_f"))
    head, tail = _struct("family", first, first, first), keep(F.right(mention, F.lit(2)))
    han = F.when(own == "", F.array(head, tail)).otherwise(F.array(head, _struct(of, own, own, own), tail))
    return F.when(kind.isNull(), F.array(keep(mention))).when(kind == "email", email).when(kind == "phone", phone).when(kind == "name", name).when(kind == "han", han).when(kind == "ip", plain("ip", " ")).when(kind == "iban", plain("iban", "[^A-Z0-9]")).when(kind == "card", plain("card", "[^0-9]")).otherwise(plain("ssn", "[^0-9]"))


def country_code(number: Column) -> Column:
    """The code that a telephone number in international form begins with, with its plus; else empty."""
    return F.regexp_extract(number, rf"^(\+(?:{CODES}))", 1)


def national(number: Column) -> Column:
    """What follows the country code."""
    return F.substring(number, F.char_length(country_code(number)) + 1, F.char_length(number))


def iban_rest(country: Column, account: Column) -> Column:
    """The number of an IBAN of lower-case letters with check digits 00, modulo 97."""
    value = lambda c: F.when(F.regexp_like(c, F.lit("^[0-9]$")), c.cast("int")).otherwise(F.ascii(c) - 87)
    return F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal digits."""
    own = key.encode()
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(c ^ x for c in own))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))), 256)


def _bytes(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """128 numbers of 0 to 255 from the keyed hash."""
    own = F.array(hmac(key, F.concat_ws("|", kind, norm, attempt.cast("string"))))
    hexed = F.array_join(F.flatten(F.transform(own, lambda h: F.array(*(F.sha2(F.concat(h, F.lit(str(i))).cast("binary"), 256) for i in range(4))))), "")
    return F.element_at(F.transform(F.array(hexed), lambda x: F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.conv(F.substring(x, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))), 1)


def _luhn(digits: Column) -> Column:
    """The sum that is 0 modulo 10 for a valid number."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: d.cast("int") * (i % 2 + 1))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v - F.when(v > 9, 9).otherwise(0)) % 10


def candidate(kind: Column, form: Column, b: Column, attempt: Column) -> Column:
    """The surrogate of an entity at an attempt, in normal form. b: the numbers of its hash."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), F.element_at(b, i) % len(values) + 1)
    letter = lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.element_at(b, i % 128 + 1) % 26 + 1, F.lit(1))
    digit = lambda i: (F.element_at(b, i % 128 + 1) % 10).cast("string")
    same = lambda c, i: F.when(F.regexp_like(c, F.lit("^[0-9]$")), digit(i)).when(F.regexp_like(c, F.lit("^[a-z]$")), letter(i)).otherwise(c)
    shaped = F.array_join(F.transform(F.split(form, ""), same), "")
    more = F.floor(attempt / 4).cast("int")  # later attempts are longer
    longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: letter(i + 100)), "")).otherwise("")
    top = F.concat(F.lit("."), F.substring_index(form, ".", -1))
    domain = F.concat(F.left(shaped, F.char_length(form) - F.char_length(top)), longer, top)
    raw = F.concat(F.left(form, F.lit(1)), F.substring(shaped, F.lit(2), F.char_length(form) - 2))
    check = F.pmod(F.lit(10) - _luhn(F.concat(raw, F.lit("0"))), F.lit(10)).cast("string")
    card = F.concat(raw, F.when(_luhn(form) == 0, check).otherwise(F.right(shaped, F.lit(1))))
    country, account = F.left(form, F.lit(2)), F.substring(shaped, F.lit(5), F.char_length(form))
    valid = F.pmod(iban_rest(country, F.substring(form, F.lit(5), F.char_length(form))) + F.substring(form, F.lit(3), F.lit(2)).cast("int"), F.lit(97)) == 1
    sums = F.lpad((98 - iban_rest(country, account)).cast("string"), 2, "0")
    iban = F.concat(country, F.when(valid, sums).otherwise(F.substring(shaped, F.lit(3), F.lit(2))), account)
    code = country_code(form)
    phone = F.concat(code, (F.element_at(b, 128) % 8 + 2).cast("string"), F.substring(shaped, F.char_length(code) + 2, F.char_length(form)))
    ssn = F.concat(F.lit("9"), F.substring(shaped, F.lit(2), F.lit(8)))  # never issued
    # the private, shared and local ranges keep the octets that make them one; no public address becomes one of them
    octet = lambda i: (F.element_at(b, i) % 254 + 1).cast("string")
    kept = F.regexp_extract(form, r"^(10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7]))\.", 1)
    free = F.element_at(F.array(*(F.lit(str(x)) for x in range(1, 224) if x not in (10, 100, 127, 169, 172, 192))), F.element_at(b, 5) % 217 + 1)
    ip = F.when(kept == "", F.concat_ws(".", free, octet(2), octet(3), octet(4))).when(F.contains(kept, F.lit(".")), F.concat_ws(".", kept, octet(3), octet(4))).otherwise(F.concat_ws(".", kept, octet(2), octet(3), octet(4)))

    def name(script: str) -> Column:
        starts, ends = SYLLABLES[script]
        end = F.when(kind == "given_m", pick(ends["given_m"], 1)).when(kind == "given_f", pick(ends["given_f"], 1)).otherwise(pick(ends["family"], 1))
        if script == "han":
            extra = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda i: F.element_at(F.array(*map(F.lit, starts)), F.element_at(b, i % 100 + 4) % len(starts) + 1)), "")).otherwise("")
            return F.when(kind == "family", F.concat(end, F.when(attempt > 0, pick(starts, 2)).otherwise(""), extra)).otherwise(F.concat(pick(starts, 2), extra, end))
        return F.concat(pick(starts, 2), pick(starts, 3), pick(starts, 4), longer if script == "latin" else F.when(more > 0, F.repeat(pick(starts, 5), more)).otherwise(""), end)

    person = F.when(F.regexp_like(form, F.lit(r"\p{IsHan}")), name("han")).when(F.regexp_like(form, F.lit(r"\p{IsCyrillic}")), name("cyrillic")).otherwise(name("latin"))
    return F.when(kind == "email", F.concat(shaped, longer)).when(kind == "domain", domain).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "ip", ip).otherwise(person)


def _number(digits: Column) -> Column:
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).cast("long")


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i) for i in range(19))), n + 1)


def permuted(digits: Column, secret: Column) -> Column:
    """Another number of as many digits (18 at most): a one-to-one map without fixed points. secret: the format's own, in hexadecimal digits.
    An unbalanced Feistel network P over the two halves, and then x goes to the inverse of P(x) + s."""
    state = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    n = F.char_length(digits)
    u = F.floor(n / 2).cast("int")
    left, right = _power(u), _power(n - u)
    mask = lambda i, x: F.conv(F.substring(F.sha2(F.concat_ws("|", secret, F.lit(str(i)), x.cast("string")).cast("binary"), 256), F.lit(1), F.lit(14)), 16, 10).cast("long")

    def step(i: int, sign: int) -> Callable[[Column], Column]:
        if i % 2:
            return lambda s: state(s["a"], F.pmod(s["b"] + sign * mask(i, s["a"]), right))
        return lambda s: state(F.pmod(s["a"] + sign * mask(i, s["b"]), left), s["b"])

    x = F.array(state(_number(F.left(digits, u)), _number(F.substring(digits, u + 1, n))))  # an array of one, so that each step is computed once
    for i in range(FEISTEL):
        x = F.transform(x, step(i, 1))
    shift = F.pmod(mask(FEISTEL, F.lit(0)), left * right - 1) + 1
    moved = F.transform(x, lambda s: F.pmod(s["a"] * right + s["b"] + shift, left * right))
    x = F.transform(moved, lambda y: state(F.call_function("div", y, right), F.pmod(y, right)))
    for i in reversed(range(FEISTEL)):
        x = F.transform(x, step(i, -1))
    text = F.transform(x, lambda s: F.concat(F.when(u > 0, F.lpad(s["a"].cast("string"), u, "0")).otherwise(""), F.lpad(s["b"].cast("string"), n - u, "0")))
    return F.element_at(text, 1)


def number_format(kind: Column, form: Column) -> Column:
    """What a permutation keeps of a number: its kind and length, and of a card its first digit and whether its check digit is right."""
    n = F.char_length(form).cast("string")
    return F.when(kind == "phone", F.concat_ws(":", kind, country_code(form), n)).when(kind == "ssn", F.concat_ws(":", kind, n)).when(kind == "card", F.concat_ws(":", kind, n, F.left(form, F.lit(1)), (_luhn(form) == 0).cast("string")))


def in_format(kind: Column, form: Column, secret: Column) -> Column:
    """The number's surrogate by permutation. A card's last digit keeps its distance from the right check digit."""
    check = lambda body: F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10))
    n = F.char_length(form)
    body = F.left(form, n - 1)
    off = F.pmod(F.right(form, F.lit(1)).cast("int") - check(body), F.lit(10))
    new = F.concat(F.left(form, F.lit(1)), permuted(F.substring(form, F.lit(2), n - 2), secret))
    card = F.element_at(F.transform(F.array(new), lambda x: F.concat(x, F.pmod(check(x) + off, F.lit(10)).cast("string"))), 1)
    return F.when(kind == "card", card).when(kind == "phone", F.concat(country_code(form), permuted(national(form), secret))).otherwise(permuted(form, secret))


def space(kind: Column, form: Column) -> Column:
    """How many numbers a number's surrogate is drawn from."""
    n = F.char_length(form)
    return F.when(kind == "phone", 8.0 * F.pow(F.lit(10.0), F.char_length(national(form)) - 1)).when(kind == "ssn", 1e8).otherwise(F.pow(F.lit(10.0), n - 2))


def surrogates(entities: DataFrame, stages: Stages, key: str) -> DataFrame:
    """(kind, norm, surrogate), one to one within each kind. entities: kind, norm, form, distinct."""
    real = entities.select("kind", F.col("form").alias("cand"))
    numbers = entities.withColumn("format", number_format(F.col("kind"), F.col("form"))).where("format is not null")
    # a row for each format: 2 * 20 lengths, and 400 of cards
    crowded = numbers.groupBy("kind", "format").agg(F.count("*").alias("n"), F.min(space(F.col("kind"), F.col("form"))).alias("of")).where(F.col("n") > F.col("of") * CROWDED).select("kind", "format")
    crowded = stages.put(crowded, "crowded")
    waiting, done = entities, None
    if not crowded.isEmpty():
        own = numbers.join(F.broadcast(crowded), ["kind", "format"])
        done = stages.put(own.select("kind", "norm", in_format(F.col("kind"), F.col("form"), hmac(key, F.col("format"))).alias("surrogate")), "permuted")
        waiting = entities.join(done.select("kind", "norm"), ["kind", "norm"], "left_anti")
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for attempt in range(MOST_ROUNDS):
        hashed = waiting.repartition(parts, "norm").withColumn("hash", _bytes(F.col("kind"), F.col("norm"), F.lit(attempt), key))
        tried = hashed.withColumn("cand", candidate(F.col("kind"), F.col("form"), F.col("hash"), F.lit(attempt)))
        tried = stages.put(tried.drop("hash"), f"tried{attempt}")
        free = tried.join(real, ["kind", "cand"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", F.col("surrogate").alias("cand")), ["kind", "cand"], "left_anti")
        won = stages.put(free.groupBy("kind", "cand").agg(F.min("norm").alias("norm")).select("kind", "norm", F.col("cand").alias("surrogate")), f"won{attempt}")
        done = won if done is None else done.unionByName(won)
        waiting = tried.drop("cand").join(won, ["kind", "norm"], "left_anti")
        if waiting.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates within {MOST_ROUNDS} rounds")


def render(piece: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate in the format of a mention's piece: its separators, and its case."""
    own = F.split(piece, "")
    is_sign = lambda c: ~F.regexp_like(c, F.lit("[0-9A-Za-z]"))
    before = lambda i: F.size(F.filter(F.slice(own, 1, i), lambda c: ~is_sign(c)))
    spaced = F.array_join(F.transform(own, lambda c, i: F.when(is_sign(c), c).otherwise(F.substring(surrogate, before(i) + 1, F.lit(1)))), "")
    spaced = F.when(kind == "iban", F.upper(spaced)).otherwise(spaced)
    cased = F.when((piece == F.upper(piece)) & (piece != F.lower(piece)), F.upper(surrogate))
    cased = cased.when(F.left(piece, F.lit(1)) != F.lower(F.left(piece, F.lit(1))), F.concat(F.upper(F.left(surrogate, F.lit(1))), F.substring(surrogate, F.lit(2), F.char_length(surrogate))))
    each = F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.get(own, i) != F.lower(F.get(own, i)), F.upper(c)).otherwise(c)), "")
    return F.when(kind.isin("card", "iban", "phone", "ssn"), spaced).when(kind.isin("email", "domain"), each).otherwise(cased.otherwise(surrogate))


def replace(df: DataFrame, key: str) -> DataFrame:
    """df with surrogates in its texts, and n_entities and entities: type:start:end of each mention in the original text."""
    stages = Stages(df.sparkSession, "pii")
    for c in [c for c in df.columns if c.lower() in ("n_entities", "entities")]:
        df = df.withColumnRenamed(c, free_name(df, c + "_"))
    # a mention holds one of these; the alternation is tried only where one is found
    signs = [F.contains("text", F.lit(x)) for x in (*MALE.split("|"), *FEMALE.split("|"), "先生", "女士")]
    may = F.regexp_like("text", F.lit("@|[0-9][^0-9]{0,3}[0-9]"))
    for sign in signs:
        may = may | sign
    has = F.coalesce(F.when(may, F.regexp_like("text", F.lit(ANY))), F.lit(False))
    hit, clean = stages.put(df.where(has), "hit"), df.where(~has)
    key_of = F.md5(F.col("text").cast("binary"))  # 128 bits
    row = [F.col("doc_id").alias("hit_id"), key_of.alias("hit_key")]
    found = hit.select(*row, F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("i", "mention")).distinct()
    found = found.withColumn("type", _type(F.col("mention")))
    pieces = found.select("hit_id", "hit_key", "i", "type", F.posexplode(parts(F.col("mention"), F.col("type"))).alias("j", "x")).select("hit_id", "hit_key", "i", "j", "type", "x.*")
    pieces = stages.put(pieces, "pieces")
    entities = stages.put(pieces.where("kind is not null").groupBy("kind", "norm").agg(F.min("form").alias("form")), "entities")
    named = surrogates(entities, stages, key).select(F.col("kind").alias("k"), F.col("norm").alias("n"), "surrogate")
    out = pieces.join(named, (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("n")), "left")
    text = F.when(F.col("kind").isNull(), F.col("piece")).otherwise(render(F.col("piece"), F.when(F.col("kind") == "phone", national(F.col("surrogate"))).otherwise(F.col("surrogate")), F.col("kind")))
    # each mention's text, then each row's mentions by place, in one shuffle
    out = out.select("hit_id", "hit_key", "i", "j", "type", text.alias("new")).repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "hit_id", "hit_key")
    each = out.groupBy("hit_id", "hit_key", "i").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", "new"))), lambda x: x["new"]), "").alias("new"), F.first("type").alias("type"))
    per_row = stages.put(each.groupBy("hit_id", "hit_key").agg(F.array_sort(F.collect_list(F.struct("i", "new", "type"))).alias("xs")), "rows")
    own, spans = free_name(hit, "own"), free_name(hit, "spans")
    gaps = F.split("text", ANY, -1)
    old = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    mine = lambda i: F.get(F.col(own)["xs"], i)
    new = F.transform(old, lambda m, i: F.coalesce(mine(i)["new"], m))
    joined = hit.join(per_row.select(F.struct("hit_id", "hit_key", "xs").alias(own)), F.col("doc_id").eqNullSafe(F.col(own)["hit_id"]) & (key_of == F.col(own)["hit_key"]), "left")
    # the patterns run again below: evenly dealt, however few partitions the join had
    joined = joined.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("doc_id"), F.xxhash64("text"))
    text = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, s: F.array(g, s))), "")
    types = F.transform(old, lambda m, i: mine(i)["type"])
    ends = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(old)).alias("g"), old.alias("m"), types.alias("t")), lambda x: F.struct((F.char_length(x["g"]) + F.char_length(x["m"])).alias("n"), F.char_length(x["m"]).alias("m"), x["t"].alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["n"]).alias("at"), F.when(x["t"].isNotNull(), F.array_append(a["out"], F.concat_ws(":", x["t"], (a["at"] + x["n"] - x["m"]).cast("string"), (a["at"] + x["n"]).cast("string")))).otherwise(a["out"]).alias("out"))
    changed = joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in df.columns], F.aggregate(ends, start, step, lambda a: a["out"]).alias(spans))
    changed = changed.select(*[F.col(c) for c in df.columns], F.size(spans).cast("long").alias("n_entities"), F.array_join(spans, ",").alias("entities"))
    return clean.select(*[F.col(c) for c in df.columns], F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities")).unionByName(changed)


def report(df: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities, entities."""
    return replace(df.select("doc_id", "text"), key)
