"""Operator 2: personal data, and the terms that give it away.

Base spans are found with four patterns.  The values found are the protected
entities.  Which other terms disclose them is a matter of information: with
counts over distinct texts, ``PMI(entity; term) / IC(entity)`` is the share of
the entity's information that a term reveals.  A term that occurs together with
an entity in enough different texts, anywhere outside the entity itself, and
reveals more than ``generalise_at`` is replaced by its kind wherever it occurs;
from ``remove_at`` on it is removed.

Everything is built from column expressions, joins and aggregates.  A null
text counts as an empty one.  Repeated rows give repeated rows and count once
in the corpus, as do all rows of equal text.  Input columns that have the name
of an added column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmark.session import checkpointed

# Kinds in their order and their patterns.  A match can only begin where the run of
# its first characters begins or where the match before ended, and runs never give characters back:
# this finds the same leftmost matches as the plain patterns in time linear in the text.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Digits that a card and a phone number have.
CARD_DIGITS, PHONE_DIGITS = (16, 19), (8, 15)
#: Terms are letter runs of at least three characters, A-Z in lower case.
TERM_BREAK = r"[^\p{L}]+"


@dataclass(frozen=True)
class Disclosure:
    """When a term counts as disclosing."""

    #: a context is a distinct text
    min_contexts: int = 3
    generalise_at: float = 0.9
    remove_at: float = 0.999
    #: so many candidate terms are sent to every executor; more are joined by a shuffle
    broadcast_terms: int = 100_000


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is a multiple of ten."""
    place = F.sequence(F.lit(1), F.length(digits))

    def worth(i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, 2 * digit).otherwise(digit)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(place, F.lit(0), lambda total, i: total + worth(i)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(*CARD_DIGITS), _luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(*PHONE_DIGITS)
    return F.lit(True)


#: A text without this has no match of the kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": "+"}


def _spans(text: Column, kind: str, pattern: Column, valid: bool = True) -> Column:
    """Spans of all matches, in code points: the lengths of gaps and matches add up to the places."""
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    step = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("found"))
    span = "array<struct<kind:string,start:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["found"])
        one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["found"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(one)).alias("spans"))

    found = F.aggregate(step, start, add, lambda state: state["spans"])
    return F.filter(found, lambda x: _valid(kind, x["value"])) if valid else found


def _base(text: Column) -> Column:
    """All base spans of a text, by kind, then start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    parts = []
    for kind in KINDS:
        hint = HINTS[kind]
        there = F.contains(text, F.lit(hint)) if len(hint) == 1 else text.rlike(hint)
        parts.append(F.when(there, _spans(text, kind, F.lit(PATTERNS[kind]))).otherwise(none))
    return F.concat(*parts)


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(_lower(text), TERM_BREAK)), lambda t: F.length(t) >= 3)


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], _lower(span["value"]))


def _own_terms(held: DataFrame) -> DataFrame:
    """``(doc, entity, own)``: the terms that ``held(doc, entity, _text, _base)`` has in the entity itself only."""
    spans = F.filter("_base", lambda s: _entity(s) == F.col("entity"))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("_text"), s["at"] + 1, x["start"] - s["at"])
        return F.struct(x["end"].alias("at"), F.concat(s["out"], gap, F.lit(" ")).alias("out"))

    outside = F.aggregate(spans, state, step, lambda s: F.concat(s["out"], F.substring(F.col("_text"), s["at"] + 1, F.lit(2147483647))))
    inside = F.flatten(F.transform(spans, lambda x: _terms(x["value"])))
    return held.select("doc", "entity", F.array_except(inside, _terms(outside)).alias("own")).where(F.size("own") > 0).distinct()


def disclosing_terms(docs: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """Terms ``(term, action, ratio)`` that reveal an entity of ``docs(_text, _base)``."""
    few = lambda df: F.broadcast(df) if df.count() <= rules.broadcast_terms else df
    texts = float(docs.agg(F.countDistinct(F.xxhash64("_text"))).first()[0])
    spanned = docs.where(F.size("_base") > 0).select("_text", "_base", F.xxhash64("_text").alias("doc"))
    entities = lambda base: F.array_distinct(F.transform(base, _entity))
    found = checkpointed(spanned.select("doc", F.explode(entities("_base")).alias("entity")).distinct())
    # an entity of fewer texts has no term that is with it in enough of them
    with_entity = few(checkpointed(found.groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity")).where(F.col("of_entity").between(rules.min_contexts, texts - 1))))
    shared = checkpointed(found.join(with_entity, "entity"))
    most = shared.agg(F.max("of_entity").cast("double")).first()[0]
    holders = few(checkpointed(shared.groupBy("doc").agg(F.max("of_entity").cast("double").alias("most"))))
    held = spanned.join(holders, "doc")
    copies = few(checkpointed(held.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")))
    terms_held = held.join(copies, "doc", "left").select("doc", "most", (1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(_terms(F.col("_text"))).alias("term"))
    # only e-mail addresses hold letters
    mails = F.filter("_base", lambda s: s["kind"] == "email")
    own = _own_terms(held.select("doc", "_text", "_base", F.explode(entities(mails)).alias("entity")).join(with_entity, "entity", "left_semi"))

    def revealed(of_term: Column, both: Column = F.col("both"), of_entity: Column = F.col("of_entity")) -> Column:
        return F.log(F.lit(texts) * both / (of_entity * of_term)) / F.log(F.lit(texts) / of_entity)

    # the texts that have a term and any shared entity are a part of those that have it, which bounds what it can reveal,
    # most of all about the entity of most texts; rows of one text count as one by their shares
    near_any = terms_held.groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("near_any")).where(F.col("near_any") >= rules.min_contexts)
    at_most = lambda of_entity: revealed(F.col("near_any"), F.least(of_entity, F.col("near_any").cast("double")), of_entity)
    near_any = few(checkpointed(near_any.where(at_most(F.lit(most)) >= rules.generalise_at if most else F.lit(False))))
    words = terms_held.join(near_any, "term").where(at_most(F.col("most")) >= rules.generalise_at).select("doc", "term", "near_any").distinct()
    pairs = checkpointed(
        shared.join(own, ["doc", "entity"], "left")
        .join(words, "doc")
        .where((at_most(F.col("of_entity").cast("double")) >= rules.generalise_at) & ~F.coalesce(F.array_contains("own", F.col("term")), F.lit(False)))
        .groupBy("entity", "term", "of_entity", "near_any")
        .agg(F.count(F.lit(1)).alias("both"))
        .where((F.col("both") >= rules.min_contexts) & (revealed(F.col("near_any")) >= rules.generalise_at))
    )
    candidates = few(checkpointed(pairs.select("term").distinct()))
    hashed = docs.select("_text", F.xxhash64("_text").alias("doc"))
    copies = few(checkpointed(hashed.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")))
    words = hashed.join(copies, "doc", "left").select((1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(_terms(F.col("_text"))).alias("term"))
    with_term = words.join(candidates, "term").groupBy("term").agg(F.round(F.sum("share")).cast("long").alias("of_term"))
    return (
        pairs.join(with_term, "term")
        .groupBy("term")
        .agg(F.max(revealed(F.col("of_term"))).alias("ratio"))
        .where(F.col("ratio") >= rules.generalise_at)
        .withColumn("action", F.when(F.col("ratio") >= rules.remove_at, "remove").otherwise("generalise"))
    )


def find(df: DataFrame, text: str = "text", key: str = "doc_id", rules: Disclosure = Disclosure()) -> DataFrame:
    """``(key, base, terms)``: base spans and spans of disclosing terms of every row."""
    docs = df.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    docs = docs.withColumn("_base", _base(F.col("_text")))
    chosen = checkpointed(disclosing_terms(docs, rules))
    if chosen.count() <= rules.broadcast_terms:
        chosen = F.broadcast(chosen)
    hits = docs.select("_key", "_text", F.explode(_terms(F.col("_text"))).alias("term")).join(chosen, "term")
    around = F.concat(F.lit(r"(?i)(?<!\p{L})"), F.col("term"), F.lit(r"(?!\p{L})"))
    placed = F.transform(_spans(F.col("_text"), "term", around, valid=False), lambda x: x.withField("kind", F.col("action")))
    terms = (
        hits.select(F.col("_key").alias("_k"), F.xxhash64("_text").alias("_h"), F.explode(placed).alias("s"))
        .groupBy("_k", "_h")
        .agg(F.sort_array(F.collect_set(F.struct("s.start", "s.end", "s.kind", "s.value"))).alias("_terms"))
    )
    base = docs.select("_key", F.xxhash64("_text").alias("_hash"), "_base")
    joined = base.join(terms, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")), "left")
    return joined.select(
        F.col("_key").alias(key),
        "_hash",
        F.col("_base").alias("base"),
        F.coalesce(F.transform("_terms", lambda x: F.struct(x["kind"], x["start"], x["end"], x["value"])), F.slice("_base", 1, 0)).alias("terms"),
    )


def sanitise(df: DataFrame, text: str = "text", key: str = "doc_id", rules: Disclosure = Disclosure()) -> DataFrame:
    """Replace the text: entities by their kind, terms by ``<term>`` or nothing; a null text stays null."""
    found = find(df, text, key, rules).select(F.col(key).alias("_k"), "_hash", F.array_sort(F.transform(F.concat("base", "terms"), lambda x: F.struct(x["start"], x["end"], x["kind"]))).alias("_all")).distinct()
    hashed = df.withColumn("_h", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = hashed.join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_hash")), "left")
    mark = lambda k: F.when(k == "remove", "").when(k == "generalise", "<term>").otherwise(F.concat(F.lit("<"), k, F.lit(">")))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(x["start"] >= s["at"], F.concat(F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"]), mark(x["kind"]))).otherwise("")
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.concat(s["out"], gap).alias("out"))

    clean = F.aggregate("_all", state, step, lambda s: F.concat(s["out"], F.substring(F.col(text), s["at"] + 1, F.lit(2147483647))))
    return joined.withColumn(text, F.when(F.col(text).isNotNull(), clean)).select(df.columns)


def _count(spans, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def digests(df: DataFrame, rules: Disclosure = Disclosure()) -> DataFrame:
    """Counts and hash of the base spans and the list of all spans, per row of (doc_id, text)."""
    found = find(df.select("doc_id", "text"), rules=rules)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [_count("base", k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "terms")).alias("spans"))
