"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

Everything is built-in SQL functions, in one pass without a shuffle. A pattern's
matches come from ``regexp_extract_all`` and the text between them from ``split``; a
running sum over both gives each match's place in code points. The patterns are
written so that Java's matcher stays linear and does not recurse: a match can only
begin at the start of a run (or where the last match ended), and repetitions are
possessive where what follows cannot need what they took. How far an account number
reaches is not known to a pattern: it matches the first four characters only and looks
ahead, and the checksum chooses among all ends that are followed by no letter or digit.

Kinds of the base set: email, ip, card (Luhn), phone. Added: iban (mod 97) and ssn,
which is kept only with a context word before it or before the list it stands in.

Cases: null and empty texts have no spans; repeated rows give repeated rows; an empty
table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a match in which context words count, back to the match before at most.
CONTEXT = 40
#: Text between the numbers of a list, all of which have the context of the first.
LISTED = r"^\s*(?:[,;/|&]\s*)?(?:(?:and|or)\s+)?$"
SPAN = "array<struct<start:int,no:int,end:int,kind:string,score:double>>"

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 20 digits passes the Luhn check."""
    padded = F.lpad(digits, 20, "0")  # leading zeros don't count
    doubled = F.translate(padded, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else padded, i, 1).cast("int")
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without spaces leaves 1 when read as a number, its first four characters last."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97)) == 1


#: Lengths of account numbers by country: a preference among ends that pass mod 97, other lengths and codes count too.
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Characters of an account number that its pattern takes.
HEAD = 4


def account(ahead: Column) -> Column:
    """The account number that a run of capitals, digits and single spaces begins with, or null.

    The one of its country's length if that passes mod 97, else the longest that does.
    """
    groups = F.split(ahead, " ")
    starts = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda k: F.array_join(F.slice(groups, 1, k), " "))
    bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    valid = F.filter(starts, lambda x: bare(x).rlike("^[A-Z0-9]{15,34}$") & mod97(bare(x)))
    usual = lambda x: F.exists(F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in LENGTHS.items())), lambda k: (k["n"] == F.length(bare(x))) & (F.instr(k["c"], F.substring(x, 1, 2)) > 0))
    return F.coalesce(F.get(F.filter(valid, usual), F.lit(0)), F.get(F.reverse(valid), F.lit(0)))


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    start: float
    context: str
    #: Added spans need this score; those of the base set are always kept.
    least: float = 0.0
    #: Characters that the pattern takes, where the confirmed match may be longer.
    head: int = 0


#: In the order in which spans that begin together are listed; the first four are the base set.
KINDS = [
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++", lambda m: F.lit(True), 0.8, "mail|contact|write to|kontakt|correo"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){11,}+", lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)), 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobil|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", lambda m: F.lit(True), 0.9, "iban|account|konto|compte|cuenta", head=HEAD),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda m: ~m.rlike("^(?:000|666|9[0-9]{2})|-00-|0000$"), 0.4, r"\bssn\b|social security", 0.5),
]


def _matches(text: Column, kind: Kind) -> Column:
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.head:  # null where nothing is confirmed
        return F.transform(F.zip_with(found, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1)), lambda m, ahead: F.concat(m, ahead)), account)
    # A cheap test spares most texts the pattern's scan.
    return F.when(F.instr(text, "@") > 0, found).otherwise(F.array().cast("array<string>")) if kind.name == "email" else found


def _spans(text: Column, matches: Column, no: int, kind: Kind) -> Column:
    pairs = F.zip_with(F.split(text, kind.pattern, -1), matches, lambda before, m: F.struct(before.alias("before"), m.alias("m")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        near = F.lower(F.right(x["before"], F.lit(CONTEXT))).rlike(kind.context) | (acc["near"] & x["before"].rlike(LISTED))
        score = F.least(F.lit(1.0), F.lit(kind.start) + F.when(near, 0.2).otherwise(0.0))
        span = F.array(F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), F.lit(kind.name).alias("kind"), score.alias("score")))
        keep = x["m"].isNotNull() & kind.valid(x["m"]) & (start >= acc["free"])
        if kind.least:
            keep = keep & (score >= kind.least)
        at = start + F.lit(kind.head) if kind.head else end
        return F.struct(at.alias("at"), near.alias("near"), F.when(keep, end).otherwise(acc["free"]).alias("free"), F.when(keep, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("near"), F.lit(0).alias("free"), F.array().cast(SPAN).alias("out"))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (start, no, end, kind, score) by start and kind; ends are exclusive, in code points."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = df.select("doc_id", "text", *(_matches(F.col("text"), k).alias(k.name) for k in KINDS))
    found = [_spans(F.col("text"), F.col(k.name), i, k) for i, k in enumerate(KINDS)]
    return df.select("doc_id", F.array_sort(F.flatten(F.array(*found))).alias("spans"))


def describe(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of spans of each base kind, digest of the base spans, all spans."""
    df = find_pii(docs, id_col, text_col)
    count = lambda i: F.size(F.filter("spans", lambda s: s["no"] == i)).cast("long")
    return df.select(
        "doc_id",
        *(count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS[:4])),
        F.sha2(describe(F.filter("spans", lambda s: s["no"] < 4)), 256).alias("base_sha256"),
        describe(F.col("spans")).alias("spans"),
    )


def redact_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of the documents, every confirmed match in the text replaced by its kind in brackets.

    Kind after kind: numbers of accounts come before the shorter kinds that could match inside them.
    """
    by = {k.name: k for k in KINDS}
    names = docs.columns
    held = "_matches"
    while held in [n.lower() for n in names]:  # whatever the table's own columns are called
        held += "_"
    for name in ("email", "iban", "card", "ip", "phone", "ssn"):
        docs = docs.withColumn(held, _matches(F.col(text_col), by[name]))
        docs = docs.withColumn(text_col, _replaced(F.col(text_col), F.col(held), by[name])).drop(held)
    return docs.select(*names)


def _replaced(text: Column, matches: Column, kind: Kind) -> Column:
    if kind.head or kind.least:
        spans, name = _spans(text, matches, 0, kind), f"[{kind.name.upper()}]"
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        cut = F.aggregate(spans, zero, lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(name)).alias("out")), lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
        return F.when(F.size(matches) > 0, cut).otherwise(text)

    def piece(before: Column, m: Column) -> Column:
        return F.concat(before, F.when(m.isNull(), "").when(kind.valid(m), f"[{kind.name.upper()}]").otherwise(m))

    return F.when(F.size(matches) > 0, F.array_join(F.zip_with(F.split(text, kind.pattern, -1), matches, piece), "")).otherwise(text)
