"""Typed values of fields, read from the chunks of a report.

Numbers are read once in each sentence with what stands around them (a currency, a per cent sign, years, a scale), so each has a kind. For a
field, numbers of its kind in sentences that use one of its phrases compete by their distance to the phrase. All steps are column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.ontology import FIELD_TERMS, NOUNS, field_kind
from .carry import pin
from .filings import NEGATION, chunk_scores

# Currencies as they stand before an amount, and words that scale it.
CURRENCY = r"(?:kshs?|kes|ksh|shs?|usd|us\$|ugx|tzs|frw|rwf|eur|gbp|zar)"
SCALES = {"thousand": 1e3, "million": 1e6, "billion": 1e9}
_NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
_WORD = "|".join(sorted(text.NUMBER_WORDS, key=len, reverse=True))
_UNIT = r"(?:\s*(?:%|per\s?cent\b|percent\b|years?\b|(?:thousand|million|billion)s?\b))?"
TYPED = rf"(?i)(?:(?:\b{CURRENCY}\b\.?|[$€£])\s*(?:{_NUMBER})|(?<![\w.,])(?:{_NUMBER}|(?:{_WORD})\b)){_UNIT}"
# What makes a bare number a year, a reference or a place in a list rather than a figure.
_REFERENCE = r"(?i)(?:\b(?:item|agenda|notes?|section|pages?|clause|paragraph|resolution|table|figure|schedule|annex\w*|appendix|no\.?|article|principle|rule)|\b(?:january|february|march|april|may|june|july|august|september|october|november|december))\s*[:.\-]?\s*$"
_MONTH_AFTER = r"(?i)^\s*(?:january|february|march|april|may|june|july|august|september|october|november|december)\b"
# A fuzzy mention is worth this many characters of distance.
LOOSE_DISTANCE = 100
PRECISE = 60


def typed_numbers(sentence: Column) -> Column:
    """``kind, value, begin, end`` of every number of a sentence: amount, percentage, age, count, or nothing known (null kind)."""
    found = F.regexp_extract_all(sentence, F.lit(TYPED), F.lit(0))
    between = F.split(sentence, TYPED, -1)

    def place(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["before"])
        end = begin + F.length(pair["token"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(pair["token"].alias("token"), begin.alias("begin"), end.alias("end")))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, t: F.struct(b.alias("before"), t.alias("token")))
    none = F.array().cast("array<struct<token:string,begin:int,end:int>>")
    placed = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), place)["out"]

    def typed(t: Column) -> Column:
        token = F.lower(t["token"])
        digits = F.replace(F.regexp_extract(token, rf"({_NUMBER})", 1), F.lit(",")).try_cast("double")
        bare = F.regexp_replace(token, r"\s*(?:%|per\s?cent|percent|years?|(?:thousand|million|billion)s?)$", "")
        value = F.coalesce(digits, text.number_word(bare).cast("double"))
        scale = reduce(lambda rest, s: F.when(token.rlike(rf"{s}s?$"), SCALES[s]).otherwise(rest), SCALES, F.lit(1.0))
        after = F.substr(sentence, t["end"] + 1, F.lit(20))
        before = F.substring_index(F.substr(sentence, F.lit(1), t["begin"]), "\n", -1)
        whole = value == F.floor(value)
        year = token.rlike(r"^(?:19|20)\d\d$")
        kind = (F.when(token.rlike(rf"^(?:{CURRENCY}\b|[$€£])"), "amount").when(token.rlike(r"(?:%|cent)$"), "percentage").when(token.rlike(r"years?$"), "age")
                .when(year | before.rlike(_REFERENCE) | after.rlike(_MONTH_AFTER) | after.rlike(r"^\s*(?:months?|days?)\b"), None)
                .when((scale > 1) | (value >= 1000), "amount").when(whole & value.between(1, 200), "count"))
        return F.struct(kind.alias("kind"), (value * scale).alias("value"), t["begin"].alias("begin"), t["end"].alias("end"))

    return F.transform(placed, typed)


def _terms_table(ontology: dict[str, dict[str, list[str]]]) -> Column:
    """field -> its kind, phrases, and the words its noun phrase must and may not hold."""
    cells = []
    for field, entry in ontology.items():
        must, bad = NOUNS.get(field, ("", "^$"))
        known = [F.struct(F.lit(p).alias("text"), F.array(*[F.lit(w) for w in text.phrase_words(p)]).cast("array<string>").alias("words")) for p in entry.get("synonyms", [])]
        phrases = F.array(*known) if known else F.array().cast("array<struct<text:string,words:array<string>>>")
        cells += [F.lit(field), F.struct(F.lit(field_kind(field)).alias("kind"), phrases.alias("phrases"), F.lit(must).alias("must"), F.lit(bad).alias("bad"))]
    return F.create_map(*cells)


def _gap(number: Column, begin: Column, end: Column) -> Column:
    return F.greatest(number["begin"] - end, begin - number["end"], F.lit(0))


def _read(sentence: Column) -> Column:
    """A sentence with what every field asks of it: lower case, words, typed numbers."""
    low = text.fold_quotes(F.lower(sentence))
    return F.struct(sentence.alias("sentence"), low.alias("low"), text.words(low).alias("words"), typed_numbers(sentence).alias("numbers"))


def _best_in_sentence(read: Column, no: Column, terms: Column) -> Column:
    """The number of the field's kind nearest to one of its phrases: ``distance, no, value, sentence``, null where there is none.

    Every occurrence of a phrase counts, up to the word in which it ends. A number's noun phrase, the words up to the next number or comma, must
    name what tells fields of one phrase apart. A phrase whose words are there but reordered or inflected is a loose mention.
    """
    sentence, low, words = read["sentence"], read["low"], read["words"]

    def spots(p: Column) -> Column:
        parts = F.split(low, F.concat(F.lit(r"\Q"), p, F.lit(r"\E")), -1)
        ends = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<int>"), lambda at, x: F.concat(
            at, F.array(F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(0)) + F.length(x) + F.length(p))))
        return F.transform(ends, lambda e: F.struct((e - F.length(p)).alias("begin"), e.alias("end")))

    def candidate(n: Column, m: Column) -> Column:
        distance = F.coalesce(F.array_min(F.transform(m["mentions"], lambda x: _gap(n, x["begin"], x["end"]))), F.when(m["loose"], F.lit(LOOSE_DISTANCE)))
        noun = F.regexp_extract(F.substr(low, n["end"] + 1, F.lit(60)), r"^(.*?)(?:[,;.\d]|\band\b|\bof whom\b|$)", 1)
        named = (terms["must"] == "") | (F.regexp_like(noun, terms["must"]) & ~F.regexp_like(noun, terms["bad"]))
        named = named | ((terms["kind"] == "age") & F.regexp_like(low, terms["must"]) & ~F.regexp_like(low, terms["bad"]))
        return F.when(named, F.struct(distance.alias("distance"), no.alias("no"), n["value"].alias("value"), sentence.alias("sentence")))

    def nearest(found: Column) -> Column:
        """Of numbers of the field's kind; what the sentence mentions is found once for all of them, and only where there are any."""
        used = F.transform(F.filter(terms["phrases"], lambda p: F.contains(low, p["text"])), lambda p: p["text"])
        loose = F.exists(terms["phrases"], lambda p: text.coverage(p["words"], words) > 0)
        told = F.array(F.struct(F.flatten(F.transform(used, spots)).alias("mentions"), loose.alias("loose")))
        each = F.transform(told, lambda m: F.array_min(F.filter(F.transform(found, lambda n: candidate(n, m)), lambda c: c["distance"].isNotNull())))
        return F.when(F.size(found) > 0, each[0])

    mine = F.filter(read["numbers"], lambda n: n["kind"] == terms["kind"])
    said = F.exists(terms["phrases"], lambda p: F.contains(low, p["text"]))
    answer = F.when(said, F.struct(F.lit(0).alias("distance"), no.alias("no"), F.when(low.rlike(NEGATION), 0.0).otherwise(1.0).alias("value"), sentence.alias("sentence")))
    return F.when(terms["kind"] == "answer", answer).otherwise(F.transform(F.array(mine), nearest)[0])


def candidates(chunks: DataFrame, ontology: dict[str, dict[str, list[str]]] = FIELD_TERMS, top: int = 5, sentences: int = 3) -> DataFrame:
    """``doc_id, field, kind, page, first_line, place, value, sentence, distance, confidence``: what the chunks that may tell a field say of it.

    Of a field's ``top`` best chunks all that hold a value are kept, with their ``sentences`` best sentences; where none does, the first other chunk
    that uses its phrases and holds one.
    """
    # reading costs far more than its bytes tell, so chunks are dealt to as many tasks as a shuffle has, which small files and merged partitions would not give
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(tasks, "doc_id", "page", "first_line")
    read = pin(chunks, __read=F.transform(text.sentences("text"), _read))  # once a chunk, for all fields
    scored = chunk_scores(read, ontology)
    table = _terms_table(ontology)
    rows = pin(scored, __terms=F.element_at(table, F.col("field"))).where("__terms.kind <> 'name'")
    found = F.transform("__read", lambda s, i: _best_in_sentence(s, i, F.col("__terms")))
    # what a field finds is read where the chunk is, so that only the best sentences travel
    rows = pin(rows, __found=F.slice(F.array_sort(F.array_compact(found)), 1, sentences), __kind=F.col("__terms.kind"))
    rows = rows.select("doc_id", "page", "first_line", "field", "score", "__found", "__kind")
    place = F.row_number().over(W.partitionBy("doc_id", "field").orderBy(F.col("score").desc(), "page", "first_line"))  # chunks of one document
    rows = rows.withColumn("place", place).where(F.size("__found") > 0)
    both = W.partitionBy("doc_id", "field")
    rows = rows.withColumn("__first", F.min("place").over(both)).withColumn("__page", F.min(F.struct("page", "first_line")).over(both))
    kept = rows.where((F.col("place") <= top) | ((F.col("__first") > top) & (F.struct("page", "first_line") == F.col("__page"))))
    kept = kept.withColumn("__best", F.explode("__found"))
    counted = F.col("__kind").isin("count", "answer")
    precise = F.when(F.col("__best.distance") <= PRECISE, 0.7).otherwise(0.5)
    strength = F.greatest(F.least(F.lit(1.0), F.col("score") / 1.3), precise) * F.when(counted, 1.0).otherwise(0.9)
    return kept.select("doc_id", "field", F.col("__kind").alias("kind"), "page", "first_line", "place", "__best.value", "__best.sentence", "__best.distance", F.bround(strength, 2).alias("confidence"))


def extract_fields(chunks: DataFrame, ontology: dict[str, dict[str, list[str]]] = FIELD_TERMS, top: int = 5, least: float = 0.45) -> DataFrame:
    """``doc_id, field, kind, page, value, sentence, confidence``: one value a field, and each number of a sentence for one field only.

    Over a document the surest pair of a field and a sentence is settled first (the nearer number on ties, then the earlier page, then the
    field's name), and both are taken: a field that loses its sentence takes its next best. So every pair is the best that both its sides can still
    have. A document holds at most fields x ``top`` x 3 pairs, which one row sorts; values under ``least`` confidence are never taken. Answers share a
    sentence freely, since one may settle several.
    """
    held = candidates(chunks, ontology, top).where(F.col("confidence") >= least)
    pair = F.struct(
        (-F.col("confidence")).alias("doubt"), "distance", "page", "first_line", "field", "kind", "value", "sentence",
        F.when(F.col("kind") == "answer", F.concat_ws("|", "field", "sentence")).otherwise(F.concat_ws("|", F.col("page").cast("string"), "sentence", F.col("value").cast("string"))).alias("source"),
    )
    lists = held.groupBy("doc_id").agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
    kind = lists.schema["pairs"].dataType
    none = F.array().cast(kind)
    settled = F.aggregate("pairs", none, lambda taken, p: F.when(F.exists(taken, lambda t: (t["field"] == p["field"]) | (t["source"] == p["source"])), taken).otherwise(F.concat(taken, F.array(p))))
    out = lists.select("doc_id", F.explode(settled).alias("p"))
    return out.select("doc_id", "p.field", "p.kind", "p.page", "p.value", "p.sentence", (-F.col("p.doubt")).alias("confidence"))
