"""Secret scanning with multipart credential linking.

Certain formats are reported on their own. Weak parts are not: a bare identifier (a user name, a
client id), a bare secret-like token or pass phrase, and an endpoint (a URL or host setting) mean
little alone. They are candidates, and an interval join within a scope decides: a weak secret is
reported if an identifier lies in its scope, a weak identifier if a secret does, an endpoint if a
linked pair does. Scopes are the blank-line separated blocks of a text. Access keys count as
identifiers and assignments as secrets in the join. A ``reach`` asks in addition for at most so many
code points between the parts; None, the default of the table functions, links throughout a scope.

Scopes never cross rows, so the join needs no shuffle: candidates of a row are sorted once and swept.
A null or empty text has no spans. Equal texts get equal spans, repeated rows a row each. An empty
table gives no rows; further columns of any name are not read (``redact`` keeps them). Whole texts are
scanned, in time linear in their length, and a task holds one Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import inf

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The certain formats.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
BASE = ("assign", "access", "hex")

# The weak parts, of any length. Possessive runs keep each pattern linear on adversarial text.
IDENT = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20?[:=]\x20?["']?([A-Za-z0-9._@-]{3,}+)""", re.ASCII | re.IGNORECASE)
PHRASE = re.compile(r"""(?<![A-Za-z0-9_])(?:pwd|pass|passphrase|private_?key|credential|auth)["']?\x20?[:=]\x20?["']?(-----BEGIN\x20[A-Z0-9\x20]++-----[^-]*+(?:-(?!----)[^-]*+)*+-----END\x20[A-Z0-9\x20]++-----|[^\s"']{6,}+)""", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{40,}+={0,2}+(?![A-Za-z0-9+/=_-])", re.ASCII)
ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]{2,}+|s3|amqp|redis|mongodb|postgres(?:ql)?)://[^\s"'<>]{4,}+|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20?[:=]\x20?["']?[A-Za-z0-9.-]{3,}+(?::[0-9]++)?""", re.ASCII | re.IGNORECASE)
WEAK = ("weak_id", "weak_secret", "endpoint")
BLANK = re.compile(r"\n[ \t\r]*\n")
#: Code points between complementary parts of one credential, for callers that look at single texts.
REACH = 240

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


def weak_parts(text: str) -> list[Span]:
    """Candidates that count only together with a complementary part."""
    found = [("weak_id", m.start(), m.end()) for m in IDENT.finditer(text)] if "=" in text or ":" in text else []
    if "=" in text or ":" in text:
        found += [("weak_secret", m.start(), m.end()) for m in PHRASE.finditer(text)]
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    for m in OPAQUE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s) and len(set(s)) >= 16:
            found.append(("weak_secret", m.start(), m.end()))
    return found


def near(parts: list[Span], others: list[Span], scopes: list[int], reach: int | None = REACH) -> list[Span]:
    """The parts that have one of the others within reach (None: anywhere) in their scope: a sweep over starts."""
    far = inf if reach is None else reach
    if not parts or not others:
        return []
    scope = lambda at: bisect_left(scopes, at)
    others = sorted({(scope(s), s, e) for _, s, e in others})
    # The two largest ends so far within a scope: spans may nest, and one of them may be the part itself.
    largest: list[tuple[tuple[int, int], ...]] = []
    for at, (block, s, e) in enumerate(others):
        before = largest[-1] if at and others[at - 1][0] == block else ()
        largest.append(tuple(sorted([*before, (e, s)], reverse=True)[:2]))
    kept = []
    for part in parts:
        at = bisect_right(others, (scope(part[1]), part[2] + far, inf)) - 1
        if at >= 0 and others[at][0] == scope(part[1]) and any((s, e) != part[1:] and e >= part[1] - far for e, s in largest[at]):
            kept.append(part)
    return kept


def linked_spans(text: str, base: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak parts that complete a credential; none overlaps a certain span."""
    taken = sorted((s, e) for _, s, e in base)
    starts, ends = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(span: Span) -> bool:
        at = bisect_left(starts, span[2])
        return not at or ends[at - 1] <= span[1]

    weak = [s for s in weak_parts(text) if free(s)]
    if not weak:
        return []
    scopes = [m.start() for m in BLANK.finditer(text)]
    of = lambda *kinds: [s for s in [*base, *weak] if s[0] in kinds]
    ids = near(of("weak_id", "access"), of("weak_secret", "assign", "hex"), scopes, reach)
    secrets = near(of("weak_secret", "assign", "hex"), of("weak_id", "access"), scopes, reach)
    hosts = near(of("endpoint"), [*ids, *secrets], scopes, reach)
    return sorted({s for s in [*ids, *secrets, *hosts] if s[0] in WEAK}, key=lambda s: (s[1], WEAK.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def all_spans(text: str | None, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Certain spans and linked weak spans of one text."""
    base = base_spans(text or "")
    return base, linked_spans(text or "", base, reach)


def scan(text: Column, reach: int | None = None) -> Column:
    """Struct(n_assign, n_access, n_hex, base_sha256, spans, n_linked) of a text column."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        order = {k: i for i, k in enumerate((*BASE, *WEAK))}
        for texts in batches:
            rows = []
            for text in texts:
                base, linked = all_spans(text, reach)
                both = sorted([*base, *linked], key=lambda s: (s[1], order[s[0]])) if linked else base
                n = [sum(s[0] == k for s in base) for k in BASE]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(both), len(linked)))
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return scanned(text)


def secret_table(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """One row per row of ``docs`` (needs doc_id, text): counts, digest and spans."""
    return docs.select("doc_id", scan(F.col("text"), reach).alias("r")).select("doc_id", "r.*")


def redact(docs: DataFrame, mask: str = "[SECRET]", reach: int | None = None) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; other columns stay."""

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                if text is not None:
                    base, linked = all_spans(text, reach)
                    end, parts = 0, []
                    for _, s, e in sorted([*base, *linked], key=lambda x: (x[1], -x[2])):
                        if s >= end:
                            parts += [text[end:s], mask]
                        end = max(end, e)
                    text = "".join([*parts, text[end:]])
                out.append(text)
            yield pd.Series(out, dtype=object)

    return docs.withColumn("text", masked(F.col("text")))
