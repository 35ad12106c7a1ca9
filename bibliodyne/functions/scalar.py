"""Scalar column jobs, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"^\s+|\s+$"
# Phrases that mark a review.
REVIEW_PHRASES = ("systematic review", "meta-analysis", "scoping review", "narrative review", "literature review")


def strip(x: Column) -> Column:
    """Trim of all white space, not of blanks only."""
    return F.regexp_replace(x, SPACE, "")


def normalize_doi(doi: Column) -> Column:
    """Bare lower-case doi without prefix, resolver or trailing slashes; null gives ''."""
    x = F.lower(strip(F.coalesce(doi, F.lit(""))))
    x = strip(F.regexp_replace(x, r"^doi:\s*", ""))
    x = F.regexp_replace(x, r"^https?://(?:dx\.)?doi\.org/", "")
    return F.regexp_replace(x, r"/+$", "")


def embed_text(*parts: Column) -> Column:
    """Non-empty parts joined by a blank."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def query_text(title: Column, abstract: Column, chars: int = 500) -> Column:
    return F.concat_ws(" ", F.nullif(title, F.lit("")), F.nullif(F.substring(abstract, 1, chars), F.lit("")))


def focused_query(title: Column, abstract: Column, finding: Column, fallback: Column, chars: int = 1000) -> Column:
    return F.coalesce(F.nullif(embed_text(title, abstract, finding), F.lit("")), F.substring(fallback, 1, chars))


def parse_authors(authors_json: Column) -> Column:
    """JSON array of strings or of name objects to 'Last, First' strings; blanks dropped, bad JSON null."""
    items = F.from_json(authors_json, "array<string>")
    name = lambda x, *keys: F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys])

    def one(x: Column) -> Column:
        last, first = strip(F.coalesce(name(x, "lastName", "last"), F.lit(""))), strip(F.coalesce(name(x, "firstName", "first"), F.lit("")))
        return F.when(F.startswith(F.ltrim(x), F.lit("{")), F.concat_ws(", ", F.nullif(last, F.lit("")), F.nullif(first, F.lit("")))).otherwise(strip(x))

    return F.filter(F.transform(items, one), lambda x: x != "")


def whole_json(text: Column) -> Column:
    """The JSON of a text as a variant; null if it is none, or if something follows the first value.

    Spark's parser stops after the first value. What follows a value cannot complete both an array and an object."""
    in_array, in_object = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.when(F.try_parse_json(in_array).isNotNull() & F.try_parse_json(in_object).isNotNull(), F.try_parse_json(text))


def parse_json_strings(text: Column) -> Column:
    """Trimmed strings of a JSON array; other kinds of items are dropped."""
    items = F.variant_get(whole_json(text), "$", "array<variant>")
    strings = F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))))
    return F.filter(strings, lambda x: x.isNotNull() & (x != ""))


def split_authors(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text, ";"), strip), lambda x: x != ""))


def parse_year(date: Column) -> Column:
    """The first part of four digits between hyphens, else 0."""
    part = F.get(F.filter(F.split(date, "-"), lambda x: x.rlike(r"^\d{4}$")), F.lit(0))
    return F.coalesce(part.try_cast("int"), F.lit(0))


def inverted_abstract(index: Column) -> Column:
    """Text of a map from word to positions."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def detect_review(types: Column, title: Column, abstract: Column, journal: Column, journals: tuple[str, ...] = ("reviews", "annual review")) -> Column:
    text = F.lower(F.concat_ws(" ", title, abstract))
    by_type = F.coalesce(F.exists(types, lambda t: F.lower(t) == "review"), F.lit(False))
    found = by_type
    for phrase in REVIEW_PHRASES:
        found = found | F.contains(text, F.lit(phrase))
    for j in journals:
        found = found | F.coalesce(F.contains(F.lower(journal), F.lit(j)), F.lit(False))
    return found


#: The weight of each signal.
SIGNAL_WEIGHTS = {"opened": 0.3, "saved": 1.0, "dismissed": -0.5, "thumbs_up": 0.8, "thumbs_down": -0.8}


def feedback_weight(signal: Column, rating: Column, weights: dict[str, float] | None = None) -> Column:
    """Weight of a signal; a rating of 1 to 5 weighs 0.5 * (rating - 3) * 0.5; anything else is null."""
    out = F.when((signal == "rated") & rating.between(1, 5), 0.5 * (rating - 3) * 0.5)
    for name, value in (weights or SIGNAL_WEIGHTS).items():
        out = out.when(signal == name, value)
    return out


def signal_sign(signal: Column, rating: Column) -> Column:
    up = signal.isin("saved", "thumbs_up") | ((signal == "rated") & (rating >= 4))
    down = signal.isin("dismissed", "thumbs_down") | ((signal == "rated") & (rating <= 2))
    return F.when(up, 1).when(down, -1).otherwise(0)


def time_decay(at: Column, now: Column, half_life_days: float = 90.0) -> Column:
    """0.5 to the power of age over half-life; a time that is null or in the future has age 0."""
    micros = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    days = F.greatest(F.coalesce(micros, F.lit(0)) / (86400.0 * 1e6), F.lit(0.0))
    return F.pow(F.lit(0.5), days / half_life_days)


def soft_gate(n: Column, least: int = 10, scale: int = 30) -> Column:
    return F.when(n < least, 0.0).otherwise(n / (n + scale))


def growth_rate(new: Column, prev: Column) -> Column:
    return new / F.greatest(prev, F.lit(1)) - 1


def parse_model_json(text: Column) -> Column:
    """The JSON of a model's answer as a variant: think blocks and code fences go; null if invalid."""
    x = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    x = F.regexp_replace(strip(x), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    return whole_json(F.nullif(strip(x), F.lit("")))


def confidence_score(fields: Column) -> Column:
    """Mean over the keys that end in _confidence: explicit 1, inferred 0.5, else 0; rounded to 3."""
    marks = F.map_values(F.map_filter(fields, lambda k, _: F.endswith(k, F.lit("_confidence")) & ~F.startswith(k, F.lit("_"))))
    total = F.aggregate(marks, F.lit(0.0), lambda acc, v: acc + F.when(v == "explicit", 1.0).when(v == "inferred", 0.5).otherwise(0.0))
    return F.when(F.size(marks) > 0, F.round(total / F.size(marks), 3)).otherwise(0.0)


def overall_confidence(extraction: Column) -> Column:
    """``_overall_confidence`` of an extraction, null if it or the JSON is bad."""
    return F.get_json_object(extraction, "$._overall_confidence").try_cast("double")


def excerpt(text: Column, chars: int = 200) -> Column:
    """At most ``chars`` characters of the trimmed text, cut at a word with an ellipsis."""
    text = strip(text)
    cut = F.regexp_replace(F.substring(text, 1, chars), r" [^ ]*$", "")
    return F.when(F.length(text) > chars, F.concat(cut, F.lit("…"))).otherwise(text)


def strip_tail(text: Column, headings: tuple[str, ...], share: float = 0.7) -> Column:
    """Text before the first of the headings that is a line of its own in the last part of the text, without
    trailing white space; a text without such a line stays as it is.

    The search runs on the part after ``share`` of the characters, with the character before it, so
    that a line start there is a real one.
    """
    start = F.floor(F.length(text) * share).cast("int")
    words = "|".join(h.replace(" ", "[ \\t]+") for h in headings)
    line = rf"\n(?:#{{1,3}}[ \t]*)?(?:{words})[ \t]*(?::[ \t]*)?(?=\n|\z)"
    tail = F.substring(text, F.greatest(start, F.lit(1)), F.length(text))
    head = F.substring(text, F.lit(1), F.greatest(start - 1, F.lit(0)))
    kept = F.regexp_replace(F.concat(head, F.regexp_replace(tail, rf"(?siu){line}.*", "")), r"\s+$", "")
    return F.when(tail.rlike(rf"(?iu){line}"), kept).otherwise(text)


#: Headings of reference lists, and those of other end matter.
REFERENCES = ("references", "bibliography", "works cited", "literature cited", "reference list", "cited works", "citations")
END_MATTER = (
    *REFERENCES, "acknowledge?ments?", "funding(?: information)?", "conflicts? of interests?", "competing interests?", "author contributions?",
    "data availability(?: statement)?", "code availability(?: statement)?", "supplementary (?:information|material|data)", "supporting information",
)


def strip_end_matter(text: Column) -> Column:
    return strip_tail(text, END_MATTER)


def strip_references(text: Column) -> Column:
    return strip_tail(text, REFERENCES)


# Latin spellings of Greek letters.
GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "u",
    "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "ch", "ψ": "ps", "ω": "o",
}


def greek_transliterated(x: Column) -> Column:
    """Lower-case Greek letters by their Latin spellings."""
    single = {k: v for k, v in GREEK.items() if len(v) == 1}
    out = F.translate(x, "".join(single), "".join(single.values()))
    for letter, name in GREEK.items():
        if len(name) > 1:
            out = F.replace(out, F.lit(letter), F.lit(name))
    return out
