"""Parts of a credential of any length are found whole."""

import random
import string

from bibliodyne.llm import secret_scan


def linked(text):
    return [(k, text[s:e]) for k, s, e in secret_scan.all_spans(text)[1]]


def test_long_parts_are_found_whole():
    random.seed(6)
    blob = lambda n: "".join(random.choices(string.ascii_letters + string.digits + "+/", k=n))
    secret, name, url = "auth: " + "Ab3!" * 500, "user = " + "m.x" * 50, "https://example.com/" + "p" * 900
    assert linked(f"{name}\n{secret}\n{url}") == [("weak_id", name), ("weak_secret", secret), ("endpoint", url)]
    pem = "private_key: -----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(blob(64) for _ in range(25)) + "\n-----END RSA PRIVATE KEY-----"
    assert ("weak_secret", pem) in linked(f"login: maria\n{pem}\nbye")
    token = blob(85) + "A1b=="
    assert linked(f"user: maria\n{token} end") == [("weak_id", "user: maria"), ("weak_secret", token)]


def test_a_long_part_links_across_the_short_ones_inside_it():
    hexes = "a1b2c3d4" * 4
    text = "token=" + ".".join(hexes for _ in range(9)) + " user: maria"
    assert [k for k, _ in linked(text)] == ["weak_id"]
    parts, others = [("weak_id", 1000, 1010)], [("assign", 0, 990), *[("hex", i, i + 32) for i in range(10, 400, 40)]]
    assert secret_scan.near(parts, others, []) == parts
    assert secret_scan.near(parts, others, [995]) == []


def test_the_table_links_throughout_a_scope(spark):
    gap = "filler words without meaning " * 400
    texts = [f"user: maria {gap}auth: Zx9!pqrs77", f"user: maria\n\n{gap}auth: Zx9!pqrs77", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.secret_table(docs).collect()}
    at = 12 + len(gap)
    assert spans == {0: f"weak_id:0:11,weak_secret:{at}:{at + 16}", 1: "", 2: "", 3: ""}
    assert {r.n_linked for r in secret_scan.secret_table(docs, reach=secret_scan.REACH).collect()} == {0}
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert masked[0] == f"[SECRET] {gap}[SECRET]" and masked[1] == texts[1] and masked[2] is None


def test_links_of_a_whole_scope_equal_all_pairs():
    rng = random.Random(4)
    pieces = ["user: maria", "login=abc", "auth: Zx9!pqrs77", "token: abcdefgh12", "https://example.com/a", "plain words " * 40, "\n\n", "AKIA" + "B" * 16, "host=db.example.org"]
    for _ in range(200):
        text = " ".join(rng.choices(pieces, k=rng.randint(2, 12)))
        scopes = [m.start() for m in secret_scan.BLANK.finditer(text)]
        block = lambda s: sum(b < s[1] for b in scopes)
        base = secret_scan.base_spans(text)
        free = [w for w in secret_scan.weak_parts(text) if all(w[2] <= s or w[1] >= e for _, s, e in base)]
        of = lambda *kinds: [s for s in [*base, *free] if s[0] in kinds]
        meets = lambda a, others: any(b[1:] != a[1:] and block(a) == block(b) for b in others)
        ids = [a for a in of("weak_id", "access") if meets(a, of("weak_secret", "assign", "hex"))]
        secrets = [a for a in of("weak_secret", "assign", "hex") if meets(a, of("weak_id", "access"))]
        hosts = [a for a in of("endpoint") if meets(a, [*ids, *secrets])]
        want = {s for s in [*ids, *secrets, *hosts] if s[0] in secret_scan.WEAK}
        assert set(secret_scan.all_spans(text, reach=None)[1]) == want
