"""Personal data in texts: fixed patterns, and terms that give protected entities away.

A protected entity is a value that a fixed pattern finds. Over all documents, the operator
counts in how many each entity occurs, each term (anywhere in a document, but touching no
fixed find), and each pair of the two. The pointwise mutual information of a pair, divided by
the entity's information content, is the share of the entity that the term discloses: 1 when
the term is never seen without it. Terms at or above the threshold, seen with the entity in
min_support documents or more, are spans of kind "term" wherever they stand in documents that
hold it (touching no fixed find); sanitised() generalises fixed finds to their kind and removes
such terms. Built-in expressions only.

No document multiplies its entities with its terms: entities that are in the same documents
count as one, terms likewise, and of a term's documents only as many are looked into for
entities as a telling pair cannot avoid, those with the fewest entities first.

Defined results: a null text counts as empty and has no spans; rows with the same id count as
one document (a row with a null id is one by itself) and each has its own spans; an empty table
gives an empty table; other columns pass through (columns named like results are replaced). Many finds in one
text, and long unbroken runs, cost little more than in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPANS, let, match_spans, no_spans, ordered_spans, replaced, running, stored, text_of

# Fixed values of the contract. Possessive repeats match the same strings without recursion; a
# run that failed from its start is not tried again from within (\G: where a match has ended).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]

TERM = r"[\p{L}][\p{L}'’-]{2,}"
#: Share of an entity's information that a term may disclose, and documents to see it in.
DISCLOSURE = 0.9
MIN_SUPPORT = 2


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    return F.when((n >= 14) & (n <= 19), let(digits, _luhn)).otherwise(F.lit(False))


def _ip(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))


def _phone(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)


def base_spans(text: Column) -> Column:
    none = no_spans()
    return F.concat(
        F.when(F.contains(text, F.lit("@")), match_spans(text, EMAIL, "email")).otherwise(none),
        match_spans(text, IP, "ip", _ip),
        # no card has fewer than 14 digits with single separators: skip texts without such a run
        F.when(text.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"), match_spans(text, CARD, "card", _card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), match_spans(text, PHONE, "phone", _phone)).otherwise(none),
    )


def _entity(span: Column) -> Column:
    """One name for the ways an entity is written: letters in lower case, numbers as digits."""
    plain = F.when(span["kind"].isin("card", "phone"), F.regexp_replace(span["value"], "[^0-9]", "")).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], plain)


def _free(terms: Column, spans: Column) -> Column:
    """The terms that touch none of the spans, by a merge of both in order of place."""
    event = lambda x, is_term: F.transform(x, lambda s: F.struct(s["start"].alias("start"), F.lit(is_term).alias("term"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))
    far = F.lit((1 << 31) - 1)

    def judged(events):
        reached = running(F.transform(events, lambda e: F.when(e["term"], F.lit(-1)).otherwise(e["end"])), F.greatest)
        # from the other side: the start of the next span
        ahead = F.reverse(running(F.transform(F.reverse(events), lambda e: F.when(e["term"], far).otherwise(e["start"])), F.least))
        free = lambda sides: F.filter(events, lambda e, i: e["term"] & (F.get(sides["reached"], i) <= e["start"]) & (F.get(sides["ahead"], i) >= e["end"]))
        return F.transform(let(F.struct(reached.alias("reached"), ahead.alias("ahead")), free), lambda e: F.struct(e["start"], e["end"], e["kind"], e["value"]))

    return let(F.sort_array(F.concat(event(spans, False), event(terms, True))), judged).cast(SPANS)


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(TERM), F.lit(0))), F.lower))


def _named(spans: Column) -> Column:
    """The distinct values of spans, in lower case."""
    return F.array_distinct(F.transform(spans, lambda s: F.lower(s["value"])))


def scan(
    df: DataFrame,
    text_column: str = "text",
    keep: list[str] | None = None,
    disclosure: float = DISCLOSURE,
    min_support: int = MIN_SUPPORT,
    id_column: str = "doc_id",
) -> DataFrame:
    """The columns keep of df (all but the text by default) and spans, by start and then kind."""
    keep = [c for c in df.columns if c != text_column] if keep is None else keep
    keep = [c for c in keep if c not in ("spans", "_row", "_doc", "_base", "_text", "_inside")]
    text = text_of(df, text_column)
    has_id = id_column in df.columns
    repeats = has_id and not df.where(F.col(id_column).isNotNull()).groupBy(id_column).count().where("count > 1").isEmpty()
    document = lambda row: F.coalesce(F.concat(F.lit("id "), F.col(id_column).cast("string")) if has_id else F.lit(None), F.concat(F.lit("row "), row.cast("string")))
    row = F.monotonically_increasing_id()
    base = df.select(*keep, row.alias("_row"), document(row).alias("_doc"), text.alias("_text"), base_spans(text).alias("_base"))
    held = F.size("_base") > 0
    outside = _named(_free(match_spans(F.col("_text"), TERM, "term"), F.col("_base")))
    # terms that a document has in fixed finds alone are none of its terms
    only_inside = F.when(held, F.array_except(_terms(F.col("_text")), outside))
    base = stored(base.select(*keep, "_row", "_doc", "_base", F.when(held, F.col("_text")).alias("_text"), only_inside.alias("_inside")), "pii")
    total = base.agg(F.countDistinct("_doc")).first()[0] if repeats else base.count()
    n = float(max(total, 1))
    own = base.where(held).select("_row", "_doc", F.array_except(_terms(F.col("_text")), F.col("_inside")).alias("_terms"), F.array_distinct(F.transform("_base", _entity)).alias("_entities"))
    holders = own.select("_row", "_doc", F.explode("_entities").alias("entity"))
    documents = F.countDistinct("_doc") if repeats else F.count("*")  # without repeated ids a row is a document
    # entities in the same documents tell the same, and so do terms: both go by the set of their documents from here on
    of_documents = [F.bit_xor(F.xxhash64(F.lit(i), "_doc")).alias(f"_set{i}") for i in (0, 1)]
    in_documents = holders.select("_doc", "entity").distinct() if repeats else holders
    entities = stored(in_documents.groupBy("entity").agg(F.count("*").alias("in_entity"), *of_documents).where(F.col("in_entity") >= min_support), "pii-entities")
    # ln(n both / (entity term)) >= d ln(n / entity) and both <= entity give term <= n^(1-d) entity^d: no telling pair has a term above
    most = lambda in_entity: n ** (1 - disclosure) * F.pow(in_entity, F.lit(disclosure)) * (1 + 1e-9)
    common = entities.agg(F.max("in_entity")).first()[0] or 0
    if repeats:
        whole = df.select(document(row).alias("_doc"), text.alias("_text"), base_spans(text).alias("_base")).where(~held).select("_doc", F.explode(_terms(F.col("_text"))).alias("term"))
        counted = whole.unionByName(own.select("_doc", F.explode("_terms").alias("term"))).distinct().select("term", F.lit(1).alias("n"))
    else:
        counted = df.select(F.explode(_terms(text)).alias("term"), F.lit(1).alias("n")).unionByName(base.where(held).select(F.explode("_inside").alias("term"), F.lit(-1).alias("n")))
    terms = counted.groupBy("term").agg(F.sum("n").alias("in_term")).where((F.col("in_term") >= min_support) & (F.col("in_term") <= most(F.lit(float(common)))))
    words = stored(own.select("_row", "_doc", F.explode("_terms").alias("term")).join(terms, "term"), "pii-words")
    held_terms = words.select("_doc", "term", "in_term").distinct() if repeats else words
    # a telling pair needs this many documents with both, and these are among the term's documents with entities
    need = F.greatest(F.lit(min_support), F.ceil(F.col("in_term") * (min_support / n) ** (1 - disclosure) * (1 - 1e-9)))
    known_terms = held_terms.groupBy("term").agg(F.first("in_term").alias("in_term"), F.count("*").alias("_held"), *of_documents).withColumn("_need", need).where(F.col("_held") >= F.col("_need"))
    renamed = lambda df, kind: df.withColumnsRenamed({f"_set{i}": f"_{kind}{i}" for i in (0, 1)})
    entity_set, term_set = ["in_entity", "_e0", "_e1"], ["in_term", "_t0", "_t1"]
    of_entities = stored(renamed(holders.join(entities, "entity"), "e").select("_row", "_doc", *entity_set).distinct(), "pii-entity-sets")
    own_terms = renamed(words.drop("in_term").join(known_terms, "term"), "t").select("_row", "_doc", "term", *term_set, "_held", "_need")
    of_terms = stored(own_terms.groupBy("_row", "_doc", *term_set, "_held", "_need").agg(F.collect_list("term").alias("_own")), "pii-term-sets")
    # so one of any held - need + 1 of them has both: those with the fewest entities are looked into
    crowd = of_entities.select("_doc", *entity_set).distinct().groupBy("_doc").agg(F.count("*").alias("_crowd"))
    by_crowd = Window.partitionBy(*term_set).orderBy("_crowd", "_doc")
    probed = of_terms.drop("_own").join(crowd, "_doc").withColumn("_nth", F.dense_rank().over(by_crowd)).where(F.col("_nth") <= F.col("_held") - F.col("_need") + 1)
    likely = probed.join(of_entities, ["_row", "_doc"]).where(F.col("in_term") <= most(F.col("in_entity"))).select(*entity_set, *term_set).distinct()
    pairs = stored(likely.join(of_terms, term_set).join(of_entities, ["_row", "_doc", *entity_set]).select("_row", "_doc", "_own", *entity_set, *term_set), "pii-pairs")
    information = F.ln(F.lit(n) / F.col("in_entity"))
    shared = F.ln(F.lit(n) * F.col("in_both") / (F.col("in_entity") * F.col("in_term")))
    telling = (
        pairs.groupBy(*entity_set, *term_set)
        .agg(documents.alias("in_both"))
        .where((F.col("in_both") >= min_support) & (information > 0) & (shared >= disclosure * information))
        .drop("in_both")
    )
    told = pairs.join(telling, [*entity_set, *term_set]).select("_row", "_own", *term_set).distinct()
    found = told.groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list("_own"))).alias("_telling"))
    marked = _free(match_spans(F.col("_text"), TERM, "term", lambda value: F.array_contains("_telling", F.lower(value))), F.col("_base"))
    marked = F.transform(marked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lower(s["value"]).alias("value")))
    return base.join(found, "_row", "left").select(
        *keep, ordered_spans(F.concat("_base", F.when(F.col("_telling").isNotNull(), marked).otherwise(no_spans())), KINDS).alias("spans")
    )


def sanitised(text: Column, spans: Column) -> Column:
    """text with fixed finds generalised to their kind and disclosing terms removed."""
    return replaced(text, spans, lambda s: F.when(s["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
