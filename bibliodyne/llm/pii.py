"""Personal data: certain formats, and terms that disclose them by co-occurrence.

Certain formats (e-mail, IP, card and phone numbers) are found by patterns. Their values are the
protected entities. A term in a document with an entity may give it away too, and how far is a matter of
information: with document frequencies over all documents, the pointwise mutual information of term
and entity, log(N * n_te / (n_t * n_e)), against the information of the entity itself, log(N / n_e), is
the share of the entity that the term discloses. From ``GENERALISE`` on a term is generalised wherever
it stands in the documents that hold that entity, from ``REMOVE`` on it is removed. Pairs seen in fewer than
``SUPPORT`` documents say nothing yet. Documents without an entity are never changed.

Everything is DataFrame expressions. Patterns are written with possessive runs and guards, which
match the same spans in time linear in the text and without deep recursion. Spans come from cutting a
text at its matches, as prefix sums of the pieces' lengths; prefix sums run in blocks, so that no array
grows by one element at a time. Which terms overlap a certain span is told by a window over both, sorted
by start. Term counts are combined before the shuffle. A share of
``GENERALISE`` or more bounds a term's document frequency by the entity's, so only terms within that
bound are paired with entities. Only texts that hold an entity are exchanged, equal ones once.

Null texts count as empty: no spans, and ``sanitize`` leaves the null. Equal rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.session import materialize, packed

KINDS = ("email", "ip", "card", "phone")
# The formats, in a form that needs no backtracking.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A cheap test that every match of a kind passes.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.95
TERM = r"[\p{L}\p{N}]{3,}"
#: Elements of a prefix sum's block, and code points of a text's piece.
RUN, PIECE = 128, 4096
#: Terms in over one of so many documents are left out by a broadcast list, if no bound admits them.
COMMON = 200


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of int the ``op`` (sum or maximum) of all elements before it, 0 for the first."""
    none = F.expr("cast(array() as array<int>)")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def scanned(v: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / RUN).cast("int"))
        blocks = F.transform(F.when(F.size(v) > 0, cuts).otherwise(none), lambda i: F.aggregate(F.slice(v, i * RUN + 1, F.lit(RUN)), start, step))
        offsets = lambda b: F.aggregate(b, start, lambda acc, x: step(acc, x["at"]), lambda acc: acc["out"])
        return _let(blocks, lambda b: F.flatten(F.zip_with(b, offsets(b), lambda x, o: F.transform(x["out"], lambda y: op(y, o)))))

    return _let(values, scanned)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct(s, e, v)> of the pattern's matches: code points, end exclusive."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def spans(pairs: Column) -> Column:
        steps = F.transform(pairs, lambda x: F.length(x["p"]) + F.length(x["m"]))
        return F.zip_with(pairs, _before(steps, lambda a, b: a + b), lambda x, at: F.struct((at + F.length(x["p"])).alias("s"), (at + F.length(x["p"]) + F.length(x["m"])).alias("e"), x["m"].alias("v")))

    # One more piece than matches; zipping pads the last match with null, which is dropped.
    return _let(F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull()), spans)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass: padding on the left changes no sum that is taken from the right."""
    padded = F.lpad(digits, 20, "0")
    total = F.lit(0)
    for i in range(20):
        d = F.substring(padded, i + 1, 1).cast("int")
        total = total + (d if i % 2 else F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct(s, e, v)> of one kind; matches that fail the kind's test are dropped."""
    spans = F.filter(_matches(text, PATTERNS[kind]), lambda x: _valid(kind, x["v"]))
    hint = HINTS[kind]
    has = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9]")
    return F.when(has, spans).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,v:string>>)"))


def _labelled(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``_base`` (all certain spans, by kind then start) and ``_key`` (of equal texts)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # A row without a digit or an @ has no span of any kind.
    some = text.rlike("[0-9@]")
    spans = F.concat(*[_labelled(k, base_spans(F.when(some, text).otherwise(""), k)) for k in KINDS])
    return docs.withColumn("_base", spans).withColumn("_key", F.sha2(text, 256))


def with_entities(based: DataFrame) -> DataFrame:
    """Adds ``_entities``: the distinct entities of the certain spans."""
    entity = lambda b: F.concat_ws(":", b["k"], F.when(b["k"] == "email", F.lower(b["v"])).when(b["k"] == "ip", b["v"]).otherwise(_digits(b["v"])))
    return based.withColumn("_entities", F.array_distinct(F.transform("_base", entity)))


def _shape(term: Column) -> Column:
    """What a generalised term becomes."""
    return F.when(term.rlike(r"\p{N}"), "<NUMBER>").when(term.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<TERM>")


def _clear_occurrences(held: DataFrame, keep: DataFrame) -> DataFrame:
    """(key, term, s, e, n_t, shape): where the terms of ``keep`` (term, n_t) stand in held texts outside certain spans.

    A term is a whole run of letters and digits, so one that a certain span runs through overlaps it.
    """
    terms = held.select("key", F.explode(_matches(F.col("text"), TERM)).alias("x")).select("key", F.lower("x.v").alias("term"), "x.s", "x.e", "x.v").join(keep, "term").withColumn("shape", _shape(F.col("v")))
    spans = held.select("key", F.explode("base").alias("x")).select("key", F.lit(None).cast("string").alias("term"), "x.s", "x.e", F.lit(None).cast("long").alias("n_t"), F.lit(None).cast("string").alias("shape"))
    by_start = W.partitionBy("key").orderBy("s", F.col("term").isNotNull())
    base_end, base_start = F.when(F.col("term").isNull(), F.col("e")), F.when(F.col("term").isNull(), F.col("s"))
    before = F.max(base_end).over(by_start.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.min(base_start).over(by_start.rowsBetween(W.currentRow, W.unboundedFollowing))
    placed = terms.select("key", "term", "s", "e", "n_t", "shape").union(spans).withColumn("before", before).withColumn("after", after).filter("term IS NOT NULL")
    return placed.filter((F.coalesce("before", F.lit(0)) <= F.col("s")) & (F.col("after").isNull() | (F.col("after") >= F.col("e")))).drop("before", "after")


def _held_texts(docs: DataFrame) -> DataFrame:
    """(key, text, base) of the distinct texts with a certain span."""
    return with_base(docs.select("text")).filter(F.size("_base") > 0).groupBy(F.col("_key").alias("key")).agg(F.first("text").alias("text"), F.first("_base").alias("base"))


def disclosing_spans(docs: DataFrame, small: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(key, terms array<struct(s, e, share, shape)>): spans of terms that disclose an entity of their text.

    ``small`` has a row for each row of ``docs``: key, base, entities (materialised, without texts).
    """
    total = small.count()
    n = float(max(total, 1))
    entities = small.filter(F.size("base") > 0).select("key", F.explode("entities").alias("entity"))
    # share >= generalise and n_te <= n_e leave a term's document frequency at most this.
    most = F.col("n_e") * F.pow(F.lit(n) / F.col("n_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    values = entities.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e").between(support, total - 1)).withColumn("most", most)
    held = materialize(entities.groupBy("key", "entity").agg(F.count("*").alias("copies")).join(values, "entity"), "pii-held")
    top = held.agg(F.max("most")).first()[0] or 0.0
    # Document frequency of the terms over the whole corpus, combined in each partition first.
    words = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    frequency = materialize(words.groupBy("term").agg(F.count("*").alias("n_t")).filter(F.col("n_t") >= support), "pii-frequency")
    # Terms that some entity's bound admits.
    common = F.broadcast(frequency.filter(F.col("n_t") > max(top, n / COMMON)).select("term"))
    admitted = frequency.join(common, "term", "left_anti").filter(F.col("n_t") <= top)
    # Texts that hold an entity seen often enough, equal ones once; read twice below.
    texts = materialize(_held_texts(docs).join(held.select("key").distinct(), "key", "left_semi"), "pii-texts")
    clear = materialize(_clear_occurrences(texts, admitted), "pii-clear")
    pairs = clear.select("key", "term", "n_t").distinct().join(held, "key").filter(F.col("n_t") <= F.col("most"))
    pairs = materialize(pairs, "pii-pairs")
    share = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e"))) / F.log(F.lit(n) / F.col("n_e"))
    counted = pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e")).filter(F.col("n_te") >= support)
    flagged = counted.withColumn("share", share).filter(F.col("share") >= generalise - 1e-12).select("entity", "term", F.least("share", F.lit(1.0)).alias("share"))
    chosen = pairs.select("key", "entity", "term").join(flagged, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    spans = clear.join(chosen, ["key", "term"]).groupBy(F.col("key").alias("term_key")).agg(F.array_sort(F.collect_list(F.struct("s", "e", "share", "shape"))).alias("terms"))
    return materialize(spans, "pii-spans")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def pii_table(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for every row of ``docs``."""
    based = with_entities(with_base(docs.select("doc_id", "text")))
    small = materialize(based.select("doc_id", F.col("_key").alias("key"), F.col("_base").alias("base"), F.col("_entities").alias("entities")), "pii-base")
    found = small.join(disclosing_spans(docs, small, support, generalise), F.col("key") == F.col("term_key"), "left")
    none = F.expr("cast(array() as array<struct<k:string,s:int,e:int>>)")
    terms = F.coalesce(F.transform("terms", lambda t: F.struct(F.lit("term").alias("k"), t["s"].alias("s"), t["e"].alias("e"))), none)
    slim = F.transform("base", lambda b: F.struct(b["k"].alias("k"), b["s"].alias("s"), b["e"].alias("e")))
    count = lambda k: F.size(F.filter("base", lambda b: b["k"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_joined(slim), 256).alias("base_sha256"), _joined(F.concat(slim, terms)).alias("spans"), F.size(terms).cast("long").alias("n_terms"),
    )


def sanitize(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with certain spans replaced by their kind and disclosing terms generalised or removed.

    A generalised term becomes ``<NAME>`` (capitalised), ``<NUMBER>`` (with a digit) or ``<TERM>``; a
    removed one leaves nothing. Overlapping spans are replaced as one, under the first one's label.
    """
    columns = docs.columns
    docs = packed(docs, "text")
    based = with_entities(with_base(docs))
    small = materialize(based.select(F.col("_key").alias("key"), F.col("_base").alias("base"), F.col("_entities").alias("entities")), "pii-base")
    spans = disclosing_spans(docs, small, support, generalise)
    joined = with_base(docs).join(spans, F.col("_key") == F.col("term_key"), "left")
    text = F.col("text")
    marks = F.concat(
        F.transform("_base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), F.concat(F.lit("<"), F.upper(b["k"]), F.lit(">")).alias("m"))),
        F.coalesce(F.transform("terms", lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), F.when(t["share"] >= remove, "").otherwise(t["shape"]).alias("m"))), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)")),
    )
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(pieces: Column, start: Column, stop: Column) -> Column:
        """The code points from start to stop, from fixed pieces: counting from the text's start each time
        would take the square of its length."""
        first, last = F.floor(start / PIECE).cast("int"), F.floor((stop - 1) / PIECE).cast("int")
        head = F.substring(F.get(pieces, first), start % PIECE + 1, F.least(stop - start, F.lit(PIECE)))
        more = F.concat(F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(F.get(pieces, last), F.lit(1), stop - last * PIECE))
        return F.when(stop <= start, "").when(first == last, head).otherwise(F.concat(head, more))

    def rewritten(marked: Column) -> Column:
        ends = _before(F.transform(marked, lambda x: x["e"]), F.greatest)
        placed = F.filter(F.arrays_zip(marked.alias("x"), ends.alias("at")), lambda y: y["x"]["s"] >= y["at"])
        end = F.array_max(F.transform(marked, lambda x: x["e"]))
        return _let(parts, lambda p: F.concat(F.array_join(F.transform(placed, lambda y: F.concat(cut(p, y["at"], y["x"]["s"]), y["x"]["m"])), ""), cut(p, end, F.length(text))))

    clean = _let(F.array_sort("_marks"), rewritten)
    done = joined.withColumn("_marks", marks).withColumn("text", F.when(F.size("_marks") > 0, clean).otherwise(text))
    quoted = lambda c: F.col("text") if c == "text" else F.col("_row")[c].alias(c)
    return done.select(*[quoted(c) for c in columns])
