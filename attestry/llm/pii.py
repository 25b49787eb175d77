"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

A kind is a pattern, a check and words. Its pattern's leftmost, non-overlapping matches are proposals
(``regexp_extract_all``); where they lie follows from the lengths of the pieces between them
(``split`` by the same pattern). A proposal that fails its check is dropped and its characters aren't
tried again. Cards must pass Luhn's test, accounts (IBAN) the remainder 97, addresses the bound 255.
The piece before and the piece behind a match hold its nearby words, read up to ``BEFORE`` and
``BEHIND`` characters, or to the next match of the kind: hints raise the score, doubts lower it.
Kinds that are ``firm`` are kept whatever their score; the others from ``LEAST_SCORE`` on.

Everything is a column function of the row: no shuffle, no Python. The patterns run possessively
from the start of each run of their characters, so that time is linear in very long words and digits.

Results for odd rows: a null or empty text has no spans; texts of any length are read whole; repeated
rows give repeated results; an empty table gives none; ids of any type pass through, null too; extra
columns aren't used and their names can't clash, as only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEFORE, BEHIND = 48, 24
LEAST_SCORE = 50

#: Lengths of account numbers by country (fixed values of the public IBAN registry).
IBAN_LENGTHS = {
    15: ["NO"],
    16: ["BE"],
    18: ["DK", "FI", "FO", "GL", "NL"],
    19: ["MK", "SI"],
    20: ["AT", "BA", "EE", "KZ", "LT", "LU", "XK"],
    21: ["CH", "HR", "LI", "LV"],
    22: ["BG", "BH", "CR", "DE", "GB", "GE", "IE", "ME", "RS"],
    23: ["AE", "GI", "IL", "IQ", "TL"],
    24: ["AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"],
    25: ["LY", "PT", "ST"],
    26: ["IS", "TR"],
    27: ["FR", "GR", "IT", "MC", "MR", "SM"],
    28: ["AL", "AZ", "BY", "CY", "DO", "GT", "HU", "LB", "PL", "SV"],
    29: ["BR", "EG", "PS", "QA", "UA"],
    30: ["JO", "KW", "MU"],
    31: ["MT", "SC"],
}
ACCOUNTS = "|".join(f"(?:{'|'.join(c)})[0-9][0-9](?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: Words beside a match, by kind, in the languages of the corpora (fixed values).
HINTS = {
    "email": ["mail", "email", "e-mail", "contact", "kontakt", "contacto", "courriel", "correo"],
    "ip": ["ip", "address", "host", "server", "adresse", "serveur", "servidor"],
    "card": ["card", "credit", "visa", "mastercard", "karte", "kreditkarte", "carte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "telefon", "handy", "portable", "llame"],
    "iban": ["iban", "bank", "account", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security", "tax id", "taxpayer"],
}
DOUBTS = ["version", "build", "isbn", "serial", "order", "invoice", "part no", "ticket"]

PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """One kind of span: its pattern, what confirms a match, its score and whether that may drop it.

    Texts without ``sign``, which every match holds, aren't searched.
    """

    name: str
    pattern: str
    check: Callable[[Column], Column]
    score: int
    firm: bool
    sign: str = ""
    bounded: bool = False
    hint: int = 15
    doubt: int = 30


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """14 to 19 digits that pass Luhn's test."""
    bare = digits(match)
    return F.length(bare).between(14, 19) & F.call_function("luhn_check", bare)


def mod97(match: Column) -> Column:
    """The number with its first four characters put last, letters as 10 to 35, leaves 1 over 97."""
    bare = F.translate(match, " ", "")
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def social(match: Column) -> Column:
    """Areas, groups and serials that are given out."""
    return ~match.rlike("^(?:000|666|9)|-00-|-0000$")


KINDS = [
    Kind(
        "email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), 85, True, "@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda m: m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"), 70, True, ".",
    ),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", luhn, 80, True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda m: F.length(digits(m)).between(10, 15), 75, True, "+"),
    Kind("iban", f"(?=[A-Z][A-Z][0-9][0-9])(?:{ACCOUNTS})", mod97, 85, False, bounded=True),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", social, 40, False, "-", bounded=True, hint=30),
]

SPAN = "array<struct<start:bigint,place:int,kind:string,end:bigint,score:int>>"


def sums_before(sizes: Column, block: int = 128) -> Column:
    """Exclusive running sums of an array of longs.

    Blocks are summed first and shifted by the blocks before them, so that no array is
    appended to more than ``block`` times, or once a block.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("sum"), F.array().cast("array<bigint>").alias("before"))

    def running(values: Column, first: Column) -> Column:
        return F.aggregate(
            values,
            first,
            lambda a, v: F.struct((a["sum"] + v).alias("sum"), F.array_append(a["before"], a["sum"]).alias("before")),
            lambda a: a["before"],
        )

    count = F.ceil(F.size(sizes) / F.lit(block)).cast("int")
    blocks = F.when(
        count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(sizes, i * block + 1, F.lit(block)))
    )
    totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, v: a + v))
    shifted = F.zip_with(
        blocks,
        running(totals, start),
        lambda b, off: running(b, F.struct(off.alias("sum"), F.array().cast("array<bigint>").alias("before"))),
    )
    return F.coalesce(F.flatten(shifted), F.array().cast("array<bigint>"))


def near(kind: Kind, words: list[str]) -> str:
    return rf"(?:^|[^a-z])(?:{'|'.join(words)})(?:[^a-z]|$)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spans_of(kind: Kind, place: int, found: Column, pieces: Column, starts: Column) -> Column:
    """The confirmed spans of a kind from its matches, the pieces around them and where they start."""

    def one(match: Column, i: Column) -> Column:
        left, right = F.get(pieces, i), F.get(pieces, i + 1)
        around = lower_ascii(F.concat(F.right(left, F.lit(BEFORE)), F.lit(" | "), F.left(right, F.lit(BEHIND))))
        score = (
            F.lit(kind.score)
            + F.when(around.rlike(near(kind, HINTS[kind.name])), kind.hint).otherwise(0)
            - F.when(around.rlike(near(kind, DOUBTS)), kind.doubt).otherwise(0)
        )
        right_one = kind.check(match)
        if kind.bounded:
            edges = F.concat(F.right(left, F.lit(1)), F.lit(" "), F.left(right, F.lit(1)))
            right_one = right_one & ~edges.rlike("[A-Za-z0-9-]")
        at = F.get(starts, i)
        return F.struct(
            at.alias("start"), F.lit(place).alias("place"), F.lit(kind.name).alias("kind"),
            (at + F.length(match)).alias("end"),
            F.when(right_one, F.least(score, F.lit(100))).alias("score"),
        )

    least = F.lit(0 if kind.firm else LEAST_SCORE)
    spans = F.filter(F.transform(found, one), lambda s: s["score"] >= least)
    return F.coalesce(F.when(F.size(found) > 0, spans), F.array()).cast(SPAN)


def find_spans(df: DataFrame, text: str = "text", out: str = "pii", kinds: list[Kind] | None = None) -> DataFrame:
    """``df`` with the array ``out`` of (start, place, kind, end, score), by start and place of the kind.

    Positions count code points from 0, ``end`` is exclusive. ``place`` is the kind's number in ``kinds``.
    """
    kinds = KINDS if kinds is None else kinds
    own = F.coalesce(F.col(text), F.lit(""))
    found = {
        f"__found_{k.name}": F.when(F.contains(own, F.lit(k.sign)), F.regexp_extract_all(own, F.lit(k.pattern), F.lit(0)))
        for k in kinds
    }
    df = df.withColumns(found)
    df = df.withColumns({
        f"__pieces_{k.name}": F.when(F.size(f"__found_{k.name}") > 0, F.split(own, k.pattern, -1)) for k in kinds
    })

    def starts(k: Kind) -> Column:
        pieces, matches = F.col(f"__pieces_{k.name}"), F.col(f"__found_{k.name}")
        steps = F.transform(matches, lambda m, i: (F.length(F.get(pieces, i)) + F.length(m)).cast("long"))
        return F.transform(sums_before(steps), lambda s, i: s + F.length(F.get(pieces, i)))

    df = df.withColumns({f"__starts_{k.name}": F.when(F.size(f"__found_{k.name}") > 0, starts(k)) for k in kinds})
    spans = [
        spans_of(k, i, F.col(f"__found_{k.name}"), F.col(f"__pieces_{k.name}"), F.col(f"__starts_{k.name}"))
        for i, k in enumerate(kinds)
    ]
    made = [f"__{part}_{k.name}" for part in ("found", "pieces", "starts") for k in kinds]
    return df.withColumn(out, F.array_sort(F.concat(*spans))).drop(*made)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of every kind, the firm spans' hash, all spans, and their scores in the same order."""
    rows = find_spans(df.select(doc_id, text), text)
    kinds = F.transform("pii", lambda s: s["kind"])
    count = [(F.size(kinds) - F.size(F.array_remove(kinds, k.name))).cast("long").alias(f"n_{k.name}") for k in KINDS]
    firm = [k.name for k in KINDS if k.firm]
    base = F.filter("pii", lambda s: s["kind"].isin(firm))
    scores = F.array_join(F.transform("pii", lambda s: s["score"].cast(T.StringType())), ",")
    n_firm = len(firm)
    return rows.select(
        doc_id, *count[:n_firm], F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"),
        listed(F.col("pii")).alias("spans"), *count[n_firm:], scores.alias("scores"),
    )


def redacted(df: DataFrame, text: str = "text", out: str = "text", mark: str = "pii") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first stands (at one start the longer one).
    """
    rows = find_spans(df, text, "__pii")
    own = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(own, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        done = F.concat(acc["done"], gap, F.lit(f"<{mark}:"), s["kind"], F.lit(">"))
        taken = s["start"] >= acc["at"]
        return F.struct(
            F.when(taken, done).otherwise(acc["done"]).alias("done"),
            F.when(taken, s["end"]).otherwise(acc["at"]).alias("at"),
        )

    longest = F.array_sort(
        "__pii",
        lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
        .when(a["end"] != b["end"], F.when(a["end"] > b["end"], -1).otherwise(1)).otherwise(0),
    )
    text_of = F.aggregate(
        longest, start, step, lambda a: F.concat(a["done"], F.substr(own, (a["at"] + 1).cast("int")))
    )
    return rows.withColumn(out, F.when(F.col(text).isNotNull(), text_of)).drop("__pii")
