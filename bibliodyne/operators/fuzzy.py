"""Fuzzy matching: Indel similarity with a native prefilter, keyed joins and greedy grouping.

Levenshtein distance is at most the Indel distance, so ratio >= r implies lev <= (1 - r / 100) * (|a| + |b|)
and a length ratio of at least r / (200 - r): both are native tests that lose nothing. Candidates come
from shared keys of rare tokens (``fuzzy_pairs``); the exact ratio runs on the survivors only.
"""

from __future__ import annotations

import math
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bibliodyne.functions.scalar import strip
from bibliodyne.functions.text import fuzzy_ratio
from bibliodyne.operators.skew import join_keys
from bibliodyne.session import materialize


def may_match(a: Column, b: Column, least: float) -> Column:
    """A native test that every pair of ratio >= ``least`` passes."""
    total = F.length(a) + F.length(b)
    near = F.least(F.length(a), F.length(b)) * 200 >= least * total
    limit = F.floor((100 - least) * total / 100 + 1e-9).cast("int")
    return near & (F.levenshtein(a, b) <= limit)


#: Lengths of one class lie within this factor; keys of a string for partners of one class, at most.
CLASS, MOST_KEYS = 1.25, 600
#: Strings under one key that meet in one task.
MEETING = 2048


def _numbered(tokens: Column) -> Column:
    """Tokens numbered by repetition, so that a multiset becomes a set."""
    return F.transform(tokens, lambda g, i: F.concat(g, F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def _tokens(x: Column) -> Column:
    """The characters and bigrams of a string, as a set each: "1" or "2", the token and its number."""
    n = F.length(x)
    letters = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("1"), F.substring(x, i, F.lit(1))))
    grams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("2"), F.substring(x, i, F.lit(2))))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.when(n > 0, F.concat(_numbered(letters), _numbered(grams))).otherwise(F.array(F.lit("1")))


def _class_of(n: int) -> int:
    return math.floor(math.log(max(n, 1), CLASS) + 1e-9)


@lru_cache(maxsize=4096)
def _lengths(group: int) -> tuple[int, ...]:
    """The lengths of a class."""
    low = max(1, math.floor(CLASS**group) - 1)
    return tuple(n for n in range(low, math.ceil(CLASS ** (group + 1)) + 2) if _class_of(n) == group)


def _common(a: int, b: int, least: float) -> int:
    """Characters that strings of these lengths have in common, in order, at a ratio of ``least``; more than the shorter one
    has if they cannot reach it."""
    return math.ceil(least * (a + b) / 200 - 1e-9)


def _shared(kind: int, a: int, b: int, least: float) -> int:
    """Tokens that such strings share at least. Of the common subsequence's neighbours each character left out on either
    side parts one pair at most; what stays together is a bigram of both."""
    both = _common(a, b, least)
    return both if kind == 1 else 3 * both - a - b - 1


@lru_cache(maxsize=65536)
def _partners(n: int, group: int, least: float) -> tuple[int, ...]:
    """Lengths of a class that a string of length ``n`` can be similar to."""
    return tuple(m for m in _lengths(group) if _common(n, m, least) <= min(n, m))


@lru_cache(maxsize=4096)
def _plan(first: int, second: int, least: float) -> tuple[int, int] | None:
    """Which tokens (1 characters, 2 bigrams), and how many of them together, are keys between two classes: the most that
    keep to ``MOST_KEYS``; bigrams if those are shared at all. None if no lengths fit."""
    met = [(n, m) for n in _lengths(first) for m in _partners(n, second, least)]
    if not met:
        return None
    for kind in (2, 1):
        some = min(_shared(kind, n, m, least) for n, m in met)
        if some < 1:
            continue
        fits = [size for size in (3, 2, 1) if size <= some and all(math.comb(max(x, y) - kind + 1 - some + size, size) <= MOST_KEYS for x, y in met)]
        return kind, max(fits, default=1)
    raise AssertionError("similar strings share a character")


def _signature(tokens: list[str], least: float) -> list[int]:
    """Keys of a string from its tokens, the rarest first. Similar strings share one: if two sets share t tokens, then
    their rarest ones, all but the last t - k of each, share k."""
    letters, grams = [t for t in tokens if t[0] == "1"], [t for t in tokens if t[0] == "2"]
    n = len(letters)
    if tokens == ["1"]:
        return [0]
    own, keys = _class_of(n), set()
    for group in range(_class_of(max(1, _common(n, 0, least) // 2)), _class_of(math.ceil(n * (200 - least) / least)) + 1):
        pair = min(own, group), max(own, group)
        lengths, plan = _partners(n, group, least), _plan(*pair, least)
        if not lengths or plan is None:
            continue
        kind, size = plan
        held = letters if kind == 1 else grams
        some = min(_shared(kind, n, m, least) for m in lengths)
        for combined in combinations(held[: len(held) - some + size], size):
            keys.add(hash_key(f"{pair}|" + "|".join(sorted(combined))))
    return list(keys)


def hash_key(text: str) -> int:
    """A number in a long for a key; unlike keys that meet in one number only lead to one more comparison."""
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def fuzzy_pairs(left: DataFrame, right: DataFrame, least: float, same: bool = False) -> DataFrame:
    """(a, b, ratio) of all pairs of strings (columns a, b) with ratio >= ``least``, each once. With ``same`` the sides are
    one table and each pair of different strings comes once, a < b.

    Strings meet under keys of one to three of their rarest bigrams (or characters, where similar strings need not share a
    bigram: short ones, and low ratios). Between strings of two length classes a ratio bounds the tokens they
    share from below, so a string's few tokens beyond that many cannot be all that they share. Keys that many
    strings have are cut into blocks of ``MEETING``."""
    @F.pandas_udf("array<long>")
    def keyed(columns: pd.Series) -> pd.Series:
        return pd.Series([_signature(list(t), least) for t in columns], dtype=object)

    def side(x: str) -> DataFrame:
        return (left if x == "a" else right).select(F.col(x).alias("x")).filter("x IS NOT NULL").distinct()

    strings = side("a") if same else side("a").union(side("b")).distinct()
    tokens = strings.select("x", F.explode(_tokens(F.col("x"))).alias("g"))
    rarity = materialize(tokens.groupBy("g").agg(F.count("*").alias("n")), "fuzzy-tokens")
    ordered = join_keys(tokens, rarity, "g", "x", "n").groupBy("x").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("t"))
    keys = materialize(ordered.select("x", F.explode(keyed(F.transform("t", lambda t: t["g"]))).alias("key")), "fuzzy-keys")
    mine = {x: keys if same else keys.join(side(x), "x", "left_semi") for x in ("a", "b")}
    sizes = mine["b"].groupBy("key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / MEETING).alias("cuts"))
    sizes = materialize(sizes.filter("n > 1") if same else sizes.join(mine["a"].select("key").distinct(), "key", "left_semi"), "fuzzy-sizes")
    ka = join_keys(mine["a"], sizes, "key", "x", "n").select(F.col("x").alias("a"), "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("cut"))
    kb = join_keys(mine["b"], sizes, "key", "x", "n").select(F.col("x").alias("b"), F.col("key").alias("key_b"), F.pmod(F.xxhash64("x"), F.col("cuts")).alias("cut_b"))
    near = F.least(F.length("a"), F.length("b")) * 200 >= least * (F.length("a") + F.length("b")) - 1e-6
    met = ka.join(kb, (F.col("key") == F.col("key_b")) & (F.col("cut") == F.col("cut_b")) & near & ((F.col("a") < F.col("b")) if same else F.lit(True)))
    pairs = met.select("a", "b").distinct().filter(may_match(F.col("a"), F.col("b"), least))
    return pairs.withColumn("ratio", fuzzy_ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= least)


#: Links of a block of terms that is settled in one task, on average.
BLOCK_LINKS = 100_000


def representatives(ranked: DataFrame, links: DataFrame, rounds: int = 24, worth: float = 0.05) -> DataFrame:
    """(term, rep): the first maximal independent set in order. A term (term, o) is a representative if none of the
    earlier terms that it is linked to (``links``: term, earlier) is one.

    A round decides all terms at once that have a representative before them, or nothing undecided; links to what
    the round before has decided then go. When a round settles less than ``worth`` of the open terms (long
    chains of names), or after ``rounds`` of them, the open terms are cut in order into blocks of about
    ``BLOCK_LINKS`` links, and these are settled one after the other: a block's terms depend on its own and on earlier
    blocks only. No task gets more than a block."""
    known = materialize(ranked.select("term").join(links.select("term").distinct(), "term", "left_anti").select("term", F.lit(True).alias("rep")), "fuzzy-known")
    done, rest = [known], materialize(links.select("term", "earlier"), "fuzzy-open")
    for _ in range(rounds):
        seen = rest.join(known.select(F.col("term").alias("earlier"), "rep"), "earlier", "left")
        told = seen.groupBy("term").agg(F.coalesce(F.bool_or("rep"), F.lit(False)).alias("covered"), F.count_if(F.col("rep").isNull()).alias("open"))
        new = materialize(told.filter("covered OR open = 0").select("term", (~F.col("covered")).alias("rep")), "fuzzy-known")
        rest = materialize(rest.join(known.select(F.col("term").alias("earlier")), "earlier", "left_anti").join(new.select("term"), "term", "left_anti"), "fuzzy-open")
        done.append(new)
        known = new
        left = rest.agg(F.count_distinct("term")).first()[0]
        if not left:
            return _all(done)
        if new.count() < worth * left:
            break
    return _all(done).unionByName(_swept(ranked, rest, known)) if not rest.isEmpty() else _all(done)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _swept(ranked: DataFrame, rest: DataFrame, known: DataFrame) -> DataFrame:
    """(term, rep) of the open terms of ``rest``, block by block in order."""
    open_terms = materialize(ranked.join(rest.select("term").distinct(), "term", "left_semi"), "fuzzy-open-terms")
    blocks = max(1, math.ceil(rest.count() / BLOCK_LINKS))
    placed = open_terms.repartitionByRange(blocks, "o", "term").select("term", "o", F.spark_partition_id().alias("block"))
    placed = materialize(placed, "fuzzy-blocks")
    of = placed.select(F.col("term").alias("earlier"), F.col("block").alias("earlier_block"))
    cut = materialize(rest.join(placed, "term").join(of, "earlier", "left"), "fuzzy-cut")
    found = known.filter("rep").select("term", "rep")
    out = []

    def settle(b: pd.DataFrame) -> pd.DataFrame:
        rep: dict[str, bool] = {}
        covered = set(b.term[b.covered])
        inner = b[b.inner]
        before = inner.groupby("term").earlier.agg(list).to_dict()
        for term in b[["o", "term"]].drop_duplicates("term").sort_values(["o", "term"]).term:
            rep[term] = term not in covered and not any(rep[e] for e in before.get(term, ()))
        return pd.DataFrame({"term": rep.keys(), "rep": rep.values()}).astype({"rep": bool})

    for block in range(blocks):
        mine = cut.filter(F.col("block") == block)
        state = found.select(F.col("term").alias("earlier"), "rep")
        seen = mine.join(state, "earlier", "left").select("term", "o", "earlier", F.coalesce("rep", F.lit(False)).alias("covered"), (F.col("earlier_block") == block).alias("inner"))
        new = materialize(seen.fillna(False, ["inner"]).groupBy(F.lit(block).alias("block")).applyInPandas(settle, "term string, rep boolean"), "fuzzy-swept")
        out.append(new)
        found = found.unionByName(new.filter("rep"))
    return _all(out)


def greedy_groups(terms: DataFrame, least: float, order: str | None = None, first: bool = False) -> DataFrame:
    """(term, representative): in order, a term joins the best representative of ratio >= ``least`` (the
    earliest among equals; with ``first`` simply the earliest) or becomes one itself.

    ``order`` names a column; by default terms sort by themselves."""
    ranked = materialize(terms.groupBy("term").agg(F.min(order or "term").alias("o")), "fuzzy-terms")
    return _decided(ranked, fuzzy_pairs(ranked.select(F.col("term").alias("a")), ranked.select(F.col("term").alias("b")), least, same=True), first)


def _decided(ranked: DataFrame, pairs: DataFrame, first: bool = False, rounds: int = 24) -> DataFrame:
    """The groups of ``greedy_groups`` from terms (term, o) and their linked pairs (a, b, ratio): who is a
    representative is settled first, and then each other term takes its best one."""
    of = lambda c: ranked.select(F.col("term").alias(c), F.col("o").alias(f"o_{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    a_first = F.struct("o_a", "a") < F.struct("o_b", "b")
    pick = lambda x, y: F.when(a_first, F.col(x)).otherwise(F.col(y))
    links = materialize(both.select(pick("b", "a").alias("term"), pick("a", "b").alias("earlier"), "ratio", pick("o_a", "o_b").alias("o")), "fuzzy-links")
    state = materialize(representatives(ranked, links, rounds), "fuzzy-representatives")
    reps = state.filter("rep").select(F.col("term").alias("earlier"))
    order = F.struct("o", "earlier") if first else F.struct((-F.col("ratio")).alias("r"), "o", "earlier")
    joined = links.join(reps, "earlier", "left_semi").groupBy("term").agg(F.min(order).alias("b")).select("term", F.col("b.earlier").alias("representative"))
    return reps.select(F.col("earlier").alias("term"), F.col("earlier").alias("representative")).unionByName(joined)


def keyword_groups(keywords: DataFrame, least: float = 88.0) -> DataFrame:
    """(term, representative) of trimmed lower-case keywords (column keyword): the earliest similar representative
    in alphabetical order."""
    plain = keywords.select(F.lower(strip(F.col("keyword"))).alias("term")).filter("term <> ''")
    return greedy_groups(plain, least, first=True)


def novel_terms(terms: DataFrame, existing: DataFrame, least: float = 85.0) -> DataFrame:
    """Terms (term, o) that match no existing name nor an earlier accepted term."""
    known = fuzzy_pairs(terms.select(F.col("term").alias("a")), existing.select(F.col("name").alias("b")), least).select(F.col("a").alias("term")).distinct()
    rest = terms.join(known, "term", "left_anti")
    return greedy_groups(rest, least, "o").filter("term = representative").select("term")


def resolve_aliases(surfaces: DataFrame, aliases: DataFrame, vocabulary: DataFrame, least: float | None = 90.0) -> DataFrame:
    """(type, surface, canonical, match_via): alias of the raw lower-case surface, alias of the normal form,
    the best fuzzy vocabulary entry of the type (``least`` None: no fuzzy step), else the normal form."""
    from bibliodyne.functions.text import basic_normalize

    rows = basic_normalize(surfaces.select("type", "surface").distinct(), "surface").withColumn("raw", F.lower(F.trim("surface")))
    table = aliases.select(F.col("type").alias("_t"), F.lower("surface").alias("_s"), "canonical")
    for key, name in (("raw", "by_raw"), ("normalized", "by_normal")):
        mine = table.withColumnRenamed("canonical", name)
        rows = rows.join(mine, (rows["type"] == mine["_t"]) & (rows[key] == mine["_s"]), "left").drop("_t", "_s")
    canonical, via = F.coalesce("by_raw", "by_normal"), F.when(F.col("by_raw").isNotNull(), "alias").when(F.col("by_normal").isNotNull(), "normalized_alias")
    if least is not None:
        open_rows = rows.filter(canonical.isNull())
        pairs = fuzzy_pairs(open_rows.select(F.col("normalized").alias("a")), vocabulary.select(F.col("canonical").alias("b")), least)
        typed = pairs.join(vocabulary.select("type", F.col("canonical").alias("b")), "b").groupBy("type", F.col("a").alias("normalized")).agg(F.max_by("b", F.struct("ratio", F.col("b"))).alias("by_fuzzy"))
        rows = rows.join(typed, ["type", "normalized"], "left")
        canonical, via = F.coalesce(canonical, "by_fuzzy"), via.when(F.col("by_fuzzy").isNotNull(), "fuzzy")
    return rows.select("type", "surface", F.coalesce(canonical, "normalized").alias("canonical"), F.coalesce(via, F.lit("identity")).alias("match_via"))


def realias(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """(old, new) of canonical ids that change under a new resolution of their surfaces."""
    now = resolved.select("type", "surface", F.col("canonical").alias("new"))
    return mentions.select("type", "surface", F.col("canonical_id").alias("old")).distinct().join(now, ["type", "surface"]).filter("old <> new").select("old", "new").distinct()


def final_names(renames: DataFrame) -> DataFrame:
    """(old, new) with every name's last one: old to new to newest. The names of a cycle, and all that lead into it,
    take its least; of several new names of one the least counts.

    Pointer jumping: each round doubles the steps that a name has gone and keeps the least name it has passed, so
    a chain of n renames takes log n rounds. The table grows with the names, so its joins are never by broadcast."""
    table = renames.filter("old IS NOT NULL AND new IS NOT NULL AND old <> new").groupBy("old").agg(F.min("new").alias("at")).withColumn("least", F.col("at"))
    table = materialize(table, "renames")
    n, steps = table.count(), 1
    while steps < n:
        ahead = table.select(F.col("old").alias("_at"), F.col("at").alias("_next"), F.col("least").alias("_least")).hint("merge")
        table = materialize(table.join(ahead, F.col("at") == F.col("_at"), "left").select("old", F.coalesce("_next", "at").alias("at"), F.least("least", F.coalesce("_least", "least")).alias("least")), "renames")
        steps *= 2
        if table.join(table.select(F.col("old").alias("at")).hint("merge"), "at", "left_semi").isEmpty():
            break
    # Who is still on the way has reached a cycle, and what its place there has passed is the whole cycle.
    there = table.select(F.col("old").alias("_at"), F.col("least").alias("_cycle")).hint("merge")
    return table.join(there, F.col("at") == F.col("_at"), "left").select("old", F.coalesce("_cycle", "at").alias("new")).filter("old <> new")


def fold_renamed(entities: DataFrame, mentions: DataFrame, relations: DataFrame, renames: DataFrame, order: Column | None = None, relation_order: Column | None = None) -> dict[str, DataFrame]:
    """The graph after renames (old, new): entities (canonical_id, ...) that now share an id are one, the row that had
    it before or else the least; mentions and relations to entities are rewritten, and of edges that fall
    together the first stays (mentions by ``order``, relations by ``relation_order``, then by all columns). No edge is left on a dead id."""
    final = materialize(final_names(renames), "final-names")

    def moved(rows: DataFrame, column: str, which: Column | None = None) -> DataFrame:
        to = final.select(F.col("old").alias("_old"), F.col("new").alias("_new")).hint("merge")
        on = F.col(column).eqNullSafe(F.col("_old")) if which is None else (F.col(column) == F.col("_old")) & which
        return rows.join(to, on, "left").withColumn("_was", F.col(column)).withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")

    def once(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
        kept = [c for c in rows.columns if c != "_was"]
        rest = [F.col(c) for c in kept]
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*by, *rest))
        return rows.withColumn("_place", place).filter("_place = 1").select(*kept)

    own = [F.col("_was") != F.col("canonical_id")]
    given = lambda by: [] if by is None else [by]
    edge = [c for c in ("doi", "canonical_id", "field", "source") if c in mentions.columns]
    typed = [c for c in ("source_doi", "doi", "predicate", "target_id", "target_kind", "prompt_version") if c in relations.columns]
    kind = F.col("target_kind") == "Entity" if "target_kind" in relations.columns else None
    return {
        "entities": once(moved(entities, "canonical_id"), ["canonical_id"], own),
        "mentions": once(moved(mentions, "canonical_id"), edge, given(order)),
        "relations": once(moved(relations, "target_id", kind), typed, given(relation_order)),
    }


def alias_proposals(surfaces: DataFrame, known: DataFrame, least: float = 80.0) -> DataFrame:
    """(type, surface, representative) of groups of two or more surfaces of a type (type, surface) that no alias of
    the type covers, regardless of case."""
    covered = known.select(F.col("type").alias("_t"), F.lower("surface").alias("_s")).distinct()
    fresh = surfaces.select("type", "surface").distinct().join(covered, (F.col("type") == F.col("_t")) & (F.lower("surface") == F.col("_s")), "left_anti")
    # Surfaces are compared once; a pair counts in every type that has both, under names that carry the type.
    fresh = materialize(fresh.select("type", "surface", F.concat_ws("\x01", "type", "surface").alias("term")), "fuzzy-surfaces")
    pairs = fuzzy_pairs(fresh.select(F.col("surface").alias("a")), fresh.select(F.col("surface").alias("b")), least, same=True)
    side = lambda c: fresh.select("type", F.col("surface").alias(c), F.col("term").alias(f"term_{c}"))
    typed = pairs.join(side("a"), "a").join(side("b"), ["type", "b"]).select(F.col("term_a").alias("a"), F.col("term_b").alias("b"), "ratio")
    groups = _decided(fresh.select("term", F.col("surface").alias("o")), typed).filter("term <> representative")
    plain = lambda c: F.substring_index(c, "\x01", -1)
    return groups.select(F.substring_index("term", "\x01", 1).alias("type"), plain("term").alias("surface"), plain("representative").alias("representative"))


def numeric_references(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Citations ``[N]`` (doi, ref_id) with the N-th reference of their paper (doi, pos from 1, ref_doi)."""
    n = F.regexp_extract("ref_id", r"^\[?\s*([0-9]{1,6})\s*\]?$", 1)
    keyed = citations.withColumn("pos", n.try_cast("int")).filter("pos IS NOT NULL")
    return keyed.join(references.select("doi", "pos", "ref_doi"), ["doi", "pos"]).select("doi", "ref_id", F.col("ref_doi").alias("target"), F.lit("numeric").alias("resolution"))


def author_year_references(citations: DataFrame, references: DataFrame, least: float = 72.0) -> DataFrame:
    """Citations like "Smith 2020" or "Smith & Jones (2020)" with the reference of the same paper (and year, if
    given) whose first author's surname is nearest to the first one cited; the earlier position among equals.
    References have surname and year."""
    rid = F.col("ref_id")
    year = F.regexp_extract(rid, r"(?U)\b((?:19|20)\d{2})\b", 1).try_cast("int")
    name = F.lower(F.regexp_extract(rid, r"(?U)^\W*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'.\-]+)", 1))
    asked = citations.withColumn("year", year).withColumn("name", name).filter("name <> ''")
    refs = references.select(F.col("doi").alias("_d"), "pos", F.col("year").alias("_y"), F.lower("surname").alias("surname"), "ref_doi")
    met = asked.join(refs, (F.col("doi") == F.col("_d")) & (F.col("year").isNull() | (F.col("year") == F.col("_y")))).filter(may_match(F.col("name"), F.col("surname"), least))
    scored = met.withColumn("ratio", fuzzy_ratio(F.col("name"), F.col("surname"))).filter(F.col("ratio") >= least)
    best = scored.groupBy("doi", "ref_id").agg(F.max_by("ref_doi", F.struct("ratio", (-F.col("pos")).alias("p"))).alias("target"))
    return best.withColumn("resolution", F.lit("fuzzy"))


def resolve_references(citations: DataFrame, references: DataFrame) -> DataFrame:
    """Every citation with its target: numeric, else fuzzy, else unresolved.

    What a later step asks of an earlier one is written once, so that nothing is made, joined or compared again for it."""
    citations, references = materialize(citations, "citations"), materialize(references, "references")
    numeric = materialize(numeric_references(citations, references), "references-numeric")
    rest = materialize(citations.join(numeric.select("doi", "ref_id"), ["doi", "ref_id"], "left_anti"), "citations-rest")
    fuzzy = materialize(author_year_references(rest, references), "references-fuzzy")
    none = rest.join(fuzzy.select("doi", "ref_id"), ["doi", "ref_id"], "left_anti").select("doi", "ref_id", F.lit(None).cast("string").alias("target"), F.lit("unresolved").alias("resolution"))
    return numeric.unionByName(fuzzy).unionByName(none)


def token_sorted(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"\s+"), lambda w: w != "")), " ")


def match_titles(citations: DataFrame, titles: DataFrame, least: float = 75.0) -> DataFrame:
    """(citation, doi, ratio): the title with the best token-sorted ratio of each citation string that is not blank;
    the smallest doi among equals."""
    asked = citations.filter(F.trim("citation") != "").select("citation").distinct().withColumn("a", token_sorted(F.col("citation")))
    known = titles.withColumn("b", token_sorted(F.col("title")))
    pairs = fuzzy_pairs(asked.select("a"), known.select("b"), least)
    met = asked.join(pairs, "a").join(known.select("doi", "b"), "b")
    return met.groupBy("citation").agg(F.min_by(F.struct("doi", "ratio"), F.struct((-F.col("ratio")).alias("r"), "doi")).alias("t")).select("citation", "t.doi", "t.ratio")


def keyword_themes(keywords: DataFrame, themes: DataFrame, least: float = 75.0) -> DataFrame:
    """(keyword, themes): themes that have the keyword, else those with a term of ratio >= ``least``."""
    k = keywords.select(F.lower("keyword").alias("a")).distinct()
    t = themes.select("theme", F.lower("term").alias("b")).distinct()
    exact = k.join(t, F.col("a") == F.col("b")).select("a", "theme")
    rest = k.join(exact, "a", "left_anti")
    near = fuzzy_pairs(rest, t.select("b"), least).join(t, "b").select("a", "theme")
    return exact.unionByName(near).groupBy(F.col("a").alias("keyword")).agg(F.array_sort(F.collect_set("theme")).alias("themes"))


def query_entities(queries: DataFrame, aliases: DataFrame, vocabulary: DataFrame, priority: tuple[str, ...] = ("method", "material", "topic", "keyword"), least: float = 85.0) -> DataFrame:
    """(query, canonical, type): the entity a text names, of the first type that resolves."""
    types = queries.select("query", F.explode(F.array(*[F.lit(p) for p in priority])).alias("type")).withColumnRenamed("query", "surface")
    found = resolve_aliases(types, aliases, vocabulary, least)
    known = found.join(vocabulary.select("type", "canonical").distinct(), ["type", "canonical"], "left_semi")
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("type"))
    return known.groupBy(F.col("surface").alias("query")).agg(F.min_by(F.struct("canonical", "type"), rank).alias("b")).select("query", "b.canonical", "b.type")
