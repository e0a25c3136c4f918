"""Personal data in texts with DataFrame functions only.

Regular expressions propose spans; checksums (Luhn for cards, mod 97 for IBANs) and ranges confirm or drop them, and
words nearby move a span's score. Offsets are running sums over the matches and the pieces between them, so no Python runs and no text is walked
once per match. The patterns use possessive loops and start only where a run of their characters starts, which makes a scan linear in
the text and never nests deeper than the pattern itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table

# Fixed values of the base kinds: what a span looks like.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Kinds that this operator adds.
_LOCAL = r"(?<![0-9+)-])(?<![0-9+)-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
# The length of an IBAN by country, as registered.
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 "
    "SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)


def _iban_pattern() -> str:
    """Country, check digits and as many characters as the country's accounts have, single spaces allowed between them."""
    by: dict[int, list[str]] = {}
    for x in _IBAN_LENGTHS.split():
        by.setdefault(int(x[2:]), []).append(x[:2])
    kinds = "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by.items()))
    return rf"(?<![A-Za-z0-9])(?:{kinds})(?![A-Za-z0-9])"


_IBAN = _iban_pattern()

#: Words that speak for a kind, looked for in the CONTEXT code points on both sides of a span.
_WORDS = {
    "email": "mail|contact|write|correo|courriel|schreib", "ip": "ip|address|host|server|adresse|direcci", "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|fax|anruf|llame|appel", "iban": "iban|account|bank|konto|cuenta|compte",
    "local_phone": "phone|call|tel|mobile|fax|anruf|llame|appel", "ssn": "ssn|social|security|sozial|seguridad|sécurité|securite",
}
CONTEXT = 40
#: Score without context, and what a word nearby adds.
_BASE = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.8, "local_phone": 0.4, "ssn": 0.4}
_NEAR = 0.3
MIN_SCORE = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone", "ssn")


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_ok(m):
    """The digits of ``m`` pass the Luhn checksum."""
    d = F.reverse(_digits(m))
    at = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))

    def add(total, i):
        x = F.try_cast(F.substring(d, i, F.lit(1)), "int") if hasattr(F, "try_cast") else F.substring(d, i, F.lit(1)).cast("int")
        y = F.when(i % 2 == 0, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return total + F.coalesce(y, F.lit(0))

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97_ok(m):
    """The IBAN check: with the first four characters last and letters as 10 to 35, the number is 1 modulo 97."""
    s = F.regexp_replace(m, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def add(r, c):
        code = F.ascii(c)
        return F.when(code < 65, (r * 10 + code - 48) % 97).otherwise((r * 100 + code - 55) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), lambda r, c: F.when(F.length(c) == 0, r).otherwise(add(r, c))) == 1


def _confirmed(kind: str, m):
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.|$)){4}$")
    if kind == "card":
        return n.between(13, 19) & luhn_ok(m)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97_ok(m)
    if kind == "ssn":
        return ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


_PATTERN = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE, "iban": _IBAN, "local_phone": _LOCAL, "ssn": _SSN}
#: A text without this has no span of the kind.
_NEEDS = {"email": "@", "phone": "+"}


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _let(value, fn):
    """``fn`` of a value that is worked out once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def running_sums(a):
    """Inclusive running sums of an array of int: each round adds what stands 1, 2, 4, ... places before, so n numbers take n log n steps."""
    rounds = F.when(F.size(a) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def add(x, k):
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.zip_with(x, F.concat(F.array_repeat(F.lit(0), far), F.slice(x, 1, F.size(x) - far)), lambda u, v: u + v)

    return F.aggregate(rounds, a, add)


def _score(kind: str, m, g, i):
    """Score of match ``i``. Context before it reaches back over one other match at most, context after it to the next one."""
    last = F.when(i > 0, F.concat(F.right(F.get(g, i - 1), F.lit(CONTEXT)), F.get(m, i - 1))).otherwise(F.lit(""))
    near = F.concat_ws("\n", F.right(F.concat(last, F.get(g, i)), F.lit(CONTEXT)), F.left(F.get(g, i + 1), F.lit(CONTEXT)))
    return F.least(F.lit(_BASE[kind]) + F.when(F.lower(near).rlike(f"(?:{_WORDS[kind]})"), F.lit(_NEAR)).otherwise(F.lit(0.0)), F.lit(1.0))


def _of_matches(kind: str, text, none, fn):
    """``fn`` of the matches of a kind and the pieces between them (one more); ``none`` for a text without a match."""
    found = F.regexp_extract_all(text, F.lit(_PATTERN[kind]), F.lit(0))
    if kind in _NEEDS:
        found = F.when(F.contains(text, F.lit(_NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    return _let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(_let(F.split(text, _PATTERN[kind], -1), lambda g: fn(m, g))))


def _spans(kind: str, text):
    """Array of the confirmed (kind, start, end, score), in order."""

    def placed(m, g):
        each = F.zip_with(m, F.slice(g, 1, F.size(m)), lambda a, b: F.length(a) + F.length(b))
        return _let(running_sums(each), lambda end: scored(m, g, end))

    def scored(m, g, end):
        at = F.transform(m, lambda v, i: F.struct(v.alias("m"), i.alias("i"), (F.get(end, i) - F.length(v)).alias("start"), F.get(end, i).alias("end")))
        at = F.filter(at, lambda x: _confirmed(kind, x["m"]))
        return F.transform(at, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(kind, m, g, x["i"]).alias("score")))

    return _of_matches(kind, text, F.array().cast(_SPANS), placed)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``id`` and an array column for each kind: its spans (kind, start, end, score) as code point offsets, end exclusive.

    Spans of the base kinds stay whatever their score; those of the others need ``min_score``. Null and empty texts have no span. A very long text, or one
    full of matches, takes time in proportion to its length (times the logarithm of its matches). Every row is kept, repeated rows and null ids too; an empty table gives an empty result; other columns play no part."""
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    keep = lambda k, a: a if k in BASE_KINDS else F.filter(a, lambda x: x["score"] >= min_score)
    return t.select("id", *[keep(k, _spans(k, F.col("t"))).alias(k) for k in kinds])


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with the spans of each kind replaced by its name in brackets, one kind after another in the given order; which spans count is as in :func:`find_spans`. Null texts stay null,
    all rows and other columns stay as they are."""
    out = docs
    for kind in kinds:

        def told(m, g, kind=kind):
            def one(v, i):
                ok = _confirmed(kind, v) if kind in BASE_KINDS else _confirmed(kind, v) & (_score(kind, m, g, i) >= min_score)
                return F.concat(F.get(g, i), F.when(ok, F.lit(f"[{kind.upper()}]")).otherwise(v))

            return F.concat(F.array_join(F.transform(m, one), ""), F.element_at(g, -1))

        text = F.col(text_col)
        out = out.withColumn(text_col, F.when(text.isNotNull(), _of_matches(kind, text, text, told)))
    return out


def op4_find_pii(spark, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    listed = lambda kinds: F.array_join(F.flatten(F.array(*[F.transform(k, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])) for k in kinds])), ",")
    return found.select(F.col("id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
                        F.sha2(F.encode(listed(BASE_KINDS), "UTF-8"), 256).alias("base_sha256"), listed(KINDS).alias("spans"))
