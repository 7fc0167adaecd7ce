"""Personal data: patterns for four kinds, and information-theoretic sanitisation around them.

What the patterns find are the protected entities. A term in a text with an entity discloses it as far as
seeing the term makes the entity likelier: pointwise mutual information of the two over whole documents,
against the information of the entity itself. A ratio of 1 means the term never occurs without the entity.
Terms above one threshold are removed, terms above a lower one are generalised to a mark, wherever they
stand in the documents that hold the entity. Column functions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import discard, stored
from trajlake.operators.grouping import join_group_values

# Kinds in the order in which spans with one start are listed. Possessive quantifiers and the look-behind
# (not within a run that failed before, unless a match ended here) give the leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
# Letters of a term; shorter ones carry too little to disclose anything.
TERM = r"[A-Za-zÀ-ɏ]{4,}"
REMOVE_AT = 0.9
GENERALISE_AT = 0.75
# Different texts in which term and entity must occur together.
MIN_SUPPORT = 3


def _may_hold(kind: str, text: Column) -> Column:
    if kind == "email":
        return text.contains("@")
    return text.contains("+") if kind == "phone" else text.rlike("[0-9]")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits, n = _digits(match), F.length(_digits(match))
    small = lambda part: (F.length(F.ltrim(part, F.lit("0"))) <= 3) & (
        F.coalesce(F.left(F.ltrim(part, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)
    return (F.when(kind == "ip", F.forall(F.split(match, r"\."), small))
            .when(kind == "card", F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", (n >= 9) & (n <= 15)).otherwise(True))


def mentions(rows: DataFrame) -> DataFrame:
    """Valid matches in (rid, text): rid, kind, start, end (code points), value.

    A text splits into what lies between matches; the lengths of those parts, summed up, give the places.
    """
    text = F.col("text")
    found = []
    for kind, pattern in PATTERNS.items():
        parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found.append(F.struct(
            F.lit(kind).alias("kind"), F.when(_may_hold(kind, text), parts).alias("parts"),
            F.when(_may_hold(kind, text), hits).alias("hits")))
    by_kind = rows.filter(text.contains("@") | text.rlike("[0-9]")).select("rid", F.inline(F.array(*found))).filter(F.size("hits") > 0)
    one = by_kind.select("rid", "kind", "parts", F.posexplode("hits").alias("i", "match")).select(
        "rid", "kind", "i", "match", F.length(F.get("parts", F.col("i"))).alias("gap"))
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.length("match")).over(upto))
    value = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(_digits(F.col("match")))
    return placed.filter(_valid(F.col("kind"), F.col("match"))).select(
        "rid", "kind", (F.col("end") - F.length("match")).alias("start"), "end", value.alias("value"))


def _blanked(text: Column, places: Column) -> Column:
    """The text with blanks at its places, sorted structs (start, end), so that all else stays where it is."""
    part = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    done = F.aggregate(
        places, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], part(acc["at"], F.greatest(s["start"], acc["at"])),
                     F.repeat(F.lit(" "), (s["end"] - F.greatest(s["start"], acc["at"])).cast("int"))).alias("out"),
            s["end"].alias("at"))))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def disclosing_terms(rows: DataFrame, entities: DataFrame, *, remove_at: float = REMOVE_AT, generalise_at: float = GENERALISE_AT,
                     min_support: int = MIN_SUPPORT, texts_of: DataFrame | None = None) -> DataFrame:
    """(rid, start, end, action) of all occurrences of the terms that disclose an entity of their document beyond a threshold.

    ``rows``: (rid, text_hash), all of them counted; ``entities``: mentions with text_hash; ``texts_of``: the stored
    table (rid, text) of the rows, which is discarded once the texts are taken from it (default: ``rows`` itself
    has the texts, and stays). Counts
    are of whole documents, without the letters inside mentions; the support is of different texts, so that
    copies do not pass for evidence. Equal texts, told by 64-bit hashes, are worked on once and count as often
    as they occur.

    Term and entity are paired only where their counts allow the lower threshold at all: they occur together
    in ``entity_docs`` documents at most, so ``term_docs`` is total * (entity_docs / total) ** generalise_at at most.
    """
    nothing = rows.select("rid", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("action")).limit(0)
    total = rows.count()
    copies = stored(rows.groupBy("text_hash").agg(F.min("rid").alias("rid"), F.count("*").alias("n")), "op1-copies")
    held = entities.drop("text_hash").join(copies, "rid").select("text_hash", "kind", "value", "n").distinct()
    protected = stored(held.groupBy("kind", "value").agg(F.sum("n").alias("entity_docs"), F.count("*").alias("texts")).filter(
        F.col("texts") >= min_support), "op1-entities")
    most = protected.agg(F.max("entity_docs")).first()[0]
    if most is None:
        return nothing
    # Rounding must not drop what just reaches the threshold.
    bound = lambda docs: F.lit(total) * F.pow(docs / F.lit(total), F.lit(generalise_at)) * (1 + 1e-9)
    held = join_group_values(held.drop("n"), protected, ["kind", "value"], how="inner", spread_by=["text_hash"]).drop("texts")
    held = stored(held, "op1-held")

    places = entities.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("places"))
    texts = (rows if texts_of is None else texts_of).select("rid", "text").join(copies, "rid").join(places, "rid", "left").select(
        "text_hash", "n", F.when(F.col("places").isNull(), F.col("text")).otherwise(_blanked(F.col("text"), F.col("places"))).alias("text"))
    texts = stored(texts, "op1-texts")
    if texts_of is not None:
        discard(texts_of)
    hits = F.regexp_extract_all(F.col("text"), F.lit(TERM), F.lit(0))
    words = lambda of: of.select("text_hash", "n", F.explode(F.array_distinct(F.transform(hits, F.lower))).alias("term"))
    terms = words(texts).groupBy("term").agg(F.sum("n").alias("term_docs"), F.count("*").alias("texts"))
    terms = stored(terms.filter((F.col("texts") >= min_support) & (F.col("term_docs") <= bound(F.lit(most)))), "op1-terms")
    concerned = texts.join(held.select("text_hash").distinct(), "text_hash", "left_semi")
    likely = join_group_values(words(concerned), terms, ["term"], how="inner", spread_by=["text_hash"])
    pairs = stored(likely.drop("texts").join(held, "text_hash").filter(F.col("term_docs") <= bound(F.col("entity_docs"))), "op1-pairs")

    rated = pairs.groupBy("term", "kind", "value").agg(
        F.sum("n").alias("together"), F.count("*").alias("texts"), F.max("term_docs").alias("term_docs"),
        F.max("entity_docs").alias("entity_docs")).filter(F.col("texts") >= min_support)
    information = F.log2(F.lit(total) / F.col("entity_docs"))
    mutual = F.log2(F.lit(total) * F.col("together") / (F.col("term_docs") * F.col("entity_docs")))
    rated = rated.withColumn("disclosure", F.when(information > 0, mutual / information).otherwise(0.0)).filter(
        F.col("disclosure") >= generalise_at)
    rated = stored(rated.select(
        "term", "kind", "value", "texts", F.when(F.col("disclosure") >= remove_at, "remove").otherwise("generalise").alias("action")), "op1-rated")
    if not rated.limit(1).count():
        return nothing
    marks = join_group_values(pairs.select("text_hash", "term", "kind", "value"), rated, ["term", "kind", "value"], how="inner",
                              spread_by=["text_hash"])
    marks = stored(marks.groupBy("text_hash", "term").agg(F.max("action").alias("action")), "op1-marks")
    marked = texts.join(marks.select("text_hash").distinct(), "text_hash", "left_semi")
    at = marked.select("text_hash", "n", F.posexplode(F.arrays_zip(
        F.split("text", TERM, -1).alias("gap"), hits.alias("match"))).alias("i", "w")).filter(F.col("w")["match"].isNotNull())
    at = at.select("text_hash", "n", "i", F.lower(F.col("w")["match"]).alias("term"), F.length(F.col("w")["gap"]).cast("long").alias("gap"),
                   F.length(F.col("w")["match"]).cast("long").alias("size"))
    upto = Window.partitionBy("text_hash").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).join(marks, ["text_hash", "term"])
    found = at.groupBy("text_hash").agg(F.max("n").alias("n"), F.collect_list(F.struct(
        (F.col("end") - F.col("size")).alias("start"), "end", "action")).alias("found"))
    found = stored(found, "op1-found")
    return join_group_values(rows.select("rid", "text_hash"), found, ["text_hash"], how="inner", spread_by=["rid"]).select("rid", F.inline("found"))


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True,
                       **thresholds: float) -> DataFrame:
    """Spans of every document: doc_id, spans (kind, start, end, action) by start and kind, and the sanitised text.

    Base spans (kinds of PATTERNS) are replaced by a mark of their kind; disclosing terms (kind ``term``)
    are removed or generalised to a mark, at each place. The letters within base spans are no terms, base
    spans always stay. Where spans of several kinds overlap, the text is replaced once, by the first.

    Null text: empty, no spans. Repeated rows are treated alike, each counted as a document; null ids
    stay null. An empty table gives no rows. Other columns are ignored.
    """
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), raw.alias("text"))
    # The places of patterns and terms are settled on a copy with row numbers.
    whole = stored(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("text_hash", F.xxhash64("text")), "op1-rows")
    rows = whole if keep_text else stored(whole.drop("text"), "op1-ids")
    entities = stored(mentions(whole).join(rows.select("rid", "text_hash"), "rid"), "op1-mentions")
    extra = disclosing_terms(rows, entities, texts_of=None if keep_text else whole, **thresholds)
    base = entities.select("rid", F.col("start").cast("long"), F.col("end").cast("long"), "kind", F.lit("mask").alias("action"))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    both = base.unionByName(extra.select("rid", F.col("start").cast("long"), F.col("end").cast("long"), F.lit("term").alias("kind"), "action"))
    spans = both.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("rank"), "kind", "end", "action"))).alias("spans"))
    out = rows.join(spans, "rid", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"), *(["text"] if keep_text else []))
    return out.withColumn("text", sanitised(F.col("text"), F.col("spans"))) if keep_text else out


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced from left to right; a span that starts within the last one is skipped."""
    mark = lambda s: F.when(s["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    part = lambda start, end: F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))
    done = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], part(acc["at"], s["start"]), mark(s)).alias("out"), s["end"].alias("at"))))
    return F.concat(done["out"], F.substring(text, (done["at"] + 1).cast("int"), F.length(text)))


def span_texts(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of some kinds, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
