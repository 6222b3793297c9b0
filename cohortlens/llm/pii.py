"""Personal data: patterns propose spans, checksums confirm them, words before them count.

Only Spark functions. Positions come from the pieces between matches, so a text is read
once a pattern, and from possessive patterns that never go back over a run of characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """``prior``: the score of a confirmed span; ``lift`` is added if ``context`` occurs in
    the 40 characters before it (or as many as there are after the match before); spans below ``least`` are dropped. ``hint``: what a text
    must have for the pattern to be worth a try."""

    name: str
    pattern: str
    hint: str
    prior: float
    context: str
    lift: float = 0.1
    least: float = 0.0


_LOCAL = "A-Za-z0-9._%+-"
#: The first four have to be found whatever their score; the others are additions.
KINDS = (
    # A match starts at the start of a run of its characters or where the last match ended:
    # if that start fails, so does every later one of the run.
    Kind("email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", ".", 0.6, r"(?i)\bip\b|address|host|server|login", 0.3),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", "0-9", 0.8, r"(?i)card|visa|master|credit|pay", 0.15),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.7, r"(?i)phone|tel|call|mobile|fax", 0.2),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", "0-9", 0.9, r"(?i)iban|account|bank", 0.1),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)ssn|social|security", 0.6, 0.5),
)
BASE = ("email", "ip", "card", "phone")
_WORDS_BEFORE = 40


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))
    def step(rest: Column, c: Column) -> Column:
        v = F.ascii(c)
        return F.when(v >= 65, (rest * 100 + v - 55) % 97).otherwise((rest * 10 + v - 48) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, found: Column) -> Column:
    """Whether the checksum or the ranges of a kind hold for a match."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda x: x.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits_of(found)).between(16, 19) & luhn(digits_of(found))
    if kind == "phone":
        return F.length(digits_of(found)).between(8, 15)
    if kind == "iban":
        return mod97(found)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,stop:int,found:string,score:double>>"


def spans(text: Column, kind: Kind) -> Column:
    """``kind, start, stop, found, score`` of the confirmed matches, in order; positions
    count code points from 0, the stop is exclusive."""
    hint = text.rlike("[0-9]") if kind.hint == "0-9" else F.instr(text, kind.hint) > 0
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))
    none = F.array().cast(_SPAN)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["g"])
        stop = start + F.coalesce(F.length(x["m"]), F.lit(0))
        near = x["g"].substr(F.greatest(F.lit(1), F.length(x["g"]) - _WORDS_BEFORE + 1), F.lit(_WORDS_BEFORE)).rlike(kind.context)
        score = F.when(near, F.lit(min(1.0, kind.prior + kind.lift))).otherwise(F.lit(kind.prior))
        one = F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), stop.alias("stop"), x["m"].alias("found"), score.alias("score"))
        good = x["m"].isNotNull() & confirmed(kind.name, x["m"]) & (score >= kind.least)
        return F.struct(stop.alias("at"), F.when(good, F.concat(state["spans"], F.array(one))).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), add, lambda s: s["spans"])
    return F.when(hint, found).otherwise(none)


def find_personal_data(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The rows and columns of ``docs`` and ``pii``: all spans by kind as listed, then start.

    A null text is an empty one; it and texts without a match have no spans. Texts are read
    whole, repeated rows answered alike, an empty table gives an empty one, a column ``pii``
    of the input is replaced and its other columns go through.
    """
    each = [spans(F.coalesce(F.col(text).cast("string"), F.lit("")), k) for k in kinds]
    return docs.withColumn("pii", F.concat(*each))


def _told(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents. A null or empty text has no span, its counts are 0 and
    its digest that of an empty text; texts are searched whole; repeated rows and null ids
    each come back; spans are sorted by kind, then start, so ties cannot arise; an empty
    table gives an empty one; further columns are ignored."""
    docs = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    n = [F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.sha2(_told(F.filter("pii", lambda s: s["kind"].isin(*BASE))), 256)
    scores = F.array_join(F.transform("pii", lambda s: F.round(s["score"], 2).cast("string")), ",")
    return docs.select("doc_id", *n, base.alias("base_sha256"), _told(F.col("pii")).alias("spans"), scores.alias("scores"))


QUERIES = {"op5_pii_spans": op5_pii_spans}
ORACLES: dict = {}
