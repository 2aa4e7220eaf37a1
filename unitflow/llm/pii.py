"""Personal data: patterns find it, corpus co-occurrence finds the terms that give it away.

All work is column expressions. Patterns are found inside the document's row; what they find are the
protected entities. All words of a document outside them are terms, and how strongly a term reveals an entity is
their pointwise mutual information as a share of the entity's information content, from counts of documents
over the whole corpus, smoothed. In documents that hold the entity, terms over a threshold are generalised, and
over a higher one removed.

Counts are combined before each shuffle and joins on terms and entities are salted. A term that is in too many
documents to reach the threshold, even if all of an entity's documents had it, is never paired with it; of entities
that no other document holds, one stands for all in its document, as their pairs have equal counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import id_of, let, text_of
from unitflow.operators.joins import join_copies
from unitflow.session import materialise

#: The kinds, in order, and their patterns. Possessive repeats match what greedy ones do here,
#: as what follows a repeat is never in its class; they keep long runs from being tried again and again.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": _LOCAL + r"++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A match starts where a run starts, or where the match before it ended.
_BEFORE = {"email": f"(?<!{_LOCAL})", "ip": "(?<![0-9])", "card": "", "phone": ""}
#: Cheap tests that a text with a match of the kind passes.
_GATE = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"\+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

TERM = "term"
SMOOTHING = 0.5  # documents without evidence that are added to each term, with the entity at its corpus share
GENERALISE = 0.8
REMOVE = 0.95
_WORD = r"[\p{L}\p{M}\p{N}]"


def _located(text: Column, pattern: Column) -> Column:
    """(start, end, value) of the matches; ``pattern`` has the text before a match as group 1 and it as 2."""

    def place(v: Column) -> Column:
        steps = F.arrays_zip(v["before"].alias("before"), v["found"].alias("found"))
        empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
        walk = F.aggregate(
            steps,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda s, x: let(
                s["at"] + F.length(x["before"]),
                lambda low: let(
                    low + F.length(x["found"]),
                    lambda high: F.struct(
                        high.alias("at"),
                        F.array_append(
                            s["out"],
                            F.struct(
                                low.alias("start"), high.alias("end"), x["found"].alias("value")
                            ),
                        ).alias("out"),
                    ),
                ),
            ),
        )
        return walk["out"]

    take = lambda group: F.regexp_extract_all(text, pattern, F.lit(group))
    return let(F.struct(take(1).alias("before"), take(2).alias("found")), place)


def _luhn(digits: Column) -> Column:
    each = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
        lambda c, i: let(
            c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(f"^{_OCTET}(?:\\.{_OCTET}){{3}}$")
    if kind == "card":
        return let(digits, lambda d: F.length(d).between(13, 19) & _luhn(d))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _of_kind(text: Column, kind: str) -> Column:
    before = _BEFORE[kind]
    lazy = f"(|.+?{before})" if before else "(.*?)"
    pattern = F.lit(f"(?s)\\G{lazy}({_PATTERN[kind]})")
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(_GATE[kind])
    return F.when(gate, F.filter(_located(text, pattern), lambda s: _passes(kind, s["value"])))


def _span(kind: str, s: Column) -> Column:
    parts = [s[name].alias(name) for name in ("start", "end", "value")]
    return F.struct(F.lit(kind).alias("kind"), *parts)


def base_spans(text: Column) -> Column:
    """All pattern matches as (kind, start, end, value), by kind in the order of KINDS, then by start.

    Code points, ``end`` exclusive. Matches of a kind are leftmost and do not overlap; one that fails the
    kind's check is dropped.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def named(kind: str) -> Column:
        found = F.coalesce(_of_kind(text, kind), none)
        return F.transform(found, lambda s: _span(kind, s))

    each = [named(kind) for kind in KINDS]
    return F.concat(*each)


def _outside(text: Column, base: Column) -> Column:
    """The text with a space for each code point of the base spans."""

    def blank(a: Column, s: Column) -> Column:
        low = F.greatest(s["start"], a["at"])
        kept = F.substring(text, a["at"] + 1, low - a["at"])
        return F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], kept, F.repeat(F.lit(" "), s["end"] - low)).alias("out"),
            )
        )

    places = F.array_sort(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walked = let(
        F.aggregate(places, start, blank),
        lambda e: F.concat(e["out"], F.substring(text, e["at"] + 1, F.length(text))),
    )
    return F.when(F.size(base) > 0, walked).otherwise(text)


def _terms(text: Column) -> Column:
    """The different words of a text, in lower case."""
    words = F.regexp_extract_all(text, F.lit(_WORD + "++"), F.lit(0))
    return F.array_distinct(F.transform(words, F.lower))


def _based(docs: DataFrame) -> DataFrame:
    # explode of one element: a barrier, so that patterns are not searched once for each use
    return docs.withColumn("base", F.explode(F.array(base_spans(F.col("text")))))


def holders(docs: DataFrame) -> DataFrame:
    """(row, id, version, entities, terms) of the documents with an entity; ``row`` is new and unique."""
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"]))
    return (
        _based(docs)
        .where(F.size("base") > 0)
        .select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            "version",
            F.array_distinct(F.transform("base", entity)).alias("entities"),
            _terms(_outside(F.col("text"), F.col("base"))).alias("terms"),
        )
    )


def disclosures(
    docs: DataFrame, held: DataFrame, smoothing: float = SMOOTHING, least: float = GENERALISE
) -> DataFrame:
    """(row, term, disclosure) of the terms in ``held`` that disclose an entity of their document by ``least``.

    disclosure = PMI(entity; term) / IC(entity), counted in rows of ``docs``. The share of the term's rows that hold
    the entity is estimated with ``smoothing`` more rows that hold it as often as all rows do, so the value
    is nearly 1 if the term is nowhere else, and nearer the more rows say so.
    """
    total = float(max(docs.count(), 1))
    n_entity, n_term, n_both = F.col("n_entity"), F.col("n_term"), F.col("n_both")
    # in how many rows a term may be for the value to reach ``least`` if all rows of the entity have it
    most = n_entity * (1 + smoothing / total) * F.pow(total / n_entity, F.lit(1 - least)) - smoothing
    entities = held.select(F.explode("entities").alias("entity")).groupBy("entity")
    entities = entities.agg(F.count("*").alias("n_entity")).where(n_entity < total)
    entities = materialise(entities.withColumn("most", most * (1 + 1e-9)), "entities")
    limit = entities.agg(F.max("most")).first()[0] or 0.0
    counts = (
        _based(docs)
        .select(F.explode(_terms(_outside(F.col("text"), F.col("base")))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    counts = materialise(counts.where(n_term <= limit), "terms")
    terms = join_copies(
        held.select("row", F.explode("terms").alias("term")), counts.withColumn("_copies", n_term), ["term"]
    )
    own = join_copies(
        held.select("row", F.explode("entities").alias("entity")),
        entities.withColumn("_copies", n_entity),
        ["entity"],
    )
    own = own.withColumn("entity", F.when(n_entity > 1, F.col("entity"))).repartition("row")
    own = own.groupBy("row", "entity").agg(F.max("n_entity").alias("n_entity"), F.max("most").alias("most"))
    pairs = terms.join(own, "row").where(n_term <= F.col("most")).drop("most")
    pairs = materialise(pairs, "pairs")
    share = (n_both + smoothing * n_entity / total) / (n_term + smoothing)
    value = F.log(share * total / n_entity) / F.log(total / n_entity)
    scored = lambda df: df.withColumn("disclosure", F.least(value, F.lit(1.0))).where(
        F.col("disclosure") >= least
    )
    alone = scored(pairs.where("entity is null").withColumn("n_both", F.lit(1)))
    met = pairs.where("entity is not null")
    told = met.groupBy("entity", "term").agg(
        F.count("*").alias("n_both"), F.max("n_term").alias("n_term"), F.max("n_entity").alias("n_entity")
    )
    told = scored(told).select("entity", "term", "disclosure", n_both.alias("_copies"))
    told = join_copies(met.select("row", "entity", "term"), materialise(told, "disclosures"), ["entity", "term"])
    out = ["row", "term", "disclosure"]
    return alone.select(*out).unionByName(told.select(*out))


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Where words of ``terms`` stand outside the base spans."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    n = F.greatest(F.floor(F.size(terms) / 8).cast("int"), F.lit(1))
    slot = lambda w: F.pmod(F.hash(w), n)
    # a word is compared with the few terms of its slot
    slots = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.filter(terms, lambda t: slot(t) == i)
    )

    def place(v: Column) -> Column:
        known = lambda w: F.array_contains(F.get(v["slots"], slot(w)), w)
        steps = F.arrays_zip(
            v["before"].alias("before"),
            v["found"].alias("found"),
            F.transform(v["found"], lambda w: let(F.lower(w), known)).alias("hit"),
        )

        def step(s: Column, x: Column) -> Column:
            low = s["at"] + F.length(x["before"])
            high = low + F.length(x["found"])
            one = F.struct(
                F.lit(TERM).alias("kind"), low.alias("start"), high.alias("end"), x["found"].alias("value")
            )
            out = F.when(x["hit"], F.array_append(s["out"], one)).otherwise(s["out"])
            return F.struct(high.alias("at"), out.alias("out"))

        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]

    pattern = F.lit(rf"\G({_WORD.replace('[', '[^')}*+)({_WORD}++)")
    take = lambda blanked, group: F.regexp_extract_all(blanked, pattern, F.lit(group))
    return let(
        _outside(text, base),
        lambda b: let(
            F.struct(slots.alias("slots"), take(b, 1).alias("before"), take(b, 2).alias("found")), place
        ),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def find_personal_data(
    docs: DataFrame,
    smoothing: float = SMOOTHING,
    generalise: float = GENERALISE,
) -> DataFrame:
    """All columns of ``docs`` plus ``base`` and ``terms``: arrays of (kind, start, end, value).

    ``base`` are the pattern matches (``base_spans``), ``terms`` the words of kind 'term' whose disclosure
    of an entity of the same document is at least ``generalise``, with ``removed`` naming those of at least
    REMOVE. Words are runs of letters, marks and digits of any length, anywhere in the document; they are not
    segmented where a script has no spaces. Equal rows are counted as they are. A null text is empty and has neither; a null id is the last one; rows with one id and different texts
    are judged apart, equal rows alike; an empty table gives none. Input columns of these names are replaced.
    """
    rows = docs.select(id_of().alias("id"), F.xxhash64(text_of()).alias("version"), text_of().alias("text"))
    held = materialise(holders(rows), "holders")
    per_doc = (
        disclosures(rows, held, smoothing, generalise)
        .join(held.select("row", "id", "version"), "row")
        .groupBy(F.col("id").alias("__id"), F.col("version").alias("__version"))
        .agg(
            F.sort_array(F.collect_set("term")).alias("__terms"),
            F.collect_set(F.when(F.col("disclosure") >= REMOVE, F.col("term"))).alias("removed"),
        )
    )
    keyed = docs.drop("base", "terms", "removed").withColumns(
        {"__id": id_of(), "__version": F.xxhash64(text_of())}
    )
    # explode of one element: a barrier, so that patterns are not searched once for each use
    based = keyed.join(per_doc, ["__id", "__version"], "left").withColumn(
        "base", F.explode(F.array(base_spans(text_of())))
    )
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    terms = F.when(
        F.size("__terms") > 0, _term_spans(text_of(), F.col("__terms"), F.col("base"))
    )
    return based.withColumn("terms", F.explode(F.array(F.coalesce(terms, none)))).drop(
        "__id", "__version", "__terms"
    )


def sanitised(text: Column, base: Column, terms: Column, removed: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; removed terms leave nothing.

    Where spans overlap, the one that starts first (or, at one place, is longer) is replaced.
    """
    spans = F.array_sort(
        F.concat(base, terms),
        lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(
            y["end"] - x["end"]
        ),
    )
    gone = lambda s: (s["kind"] == TERM) & F.array_contains(removed, F.lower(s["value"]))
    put = lambda s: F.when(gone(s), "").otherwise(F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
    step = lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), put(s)).alias(
                "out"
            ),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = F.aggregate(spans, start, step)
    return let(end, lambda e: F.concat(e["out"], F.substring(text, e["at"] + 1, F.length(text))))


def counts_of(base: Column) -> dict[str, Column]:
    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return {f"n_{kind}": count(kind) for kind in KINDS}
