"""Disclosing terms anywhere in the documents that hold an entity."""

from bibliodyne.llm import pii


def test_terms_far_from_the_entity_are_counted_and_all_mentions_marked(spark):
    filler = lambda i: " ".join(f"w{(i * 7 + k) % 90}x" for k in range(40))
    far = [(i, f"Quillfeather {filler(i)} bo@mail.example.com {filler(i + 3)} quillfeather. {filler(i + 5)}") for i in range(6)]
    both = [(i, f"{filler(i)} zanzibar ann@mail.example.com {filler(i + 3)} Zanzibar {filler(i + 5)}") for i in range(10, 16)]
    # A run of letters that a certain span cuts is no term; 192.0.2.7 cuts 7brimstone.
    cut = [(i, f"{filler(i)} 192.0.2.7brimstone {filler(i)}") for i in range(20, 26)]
    plain = [(i, filler(i)) for i in range(30, 150)] + [(200, "zanzibar alone is left")]
    df = spark.createDataFrame(far + both + cut + plain, "doc_id long, text string")
    found = {r.doc_id: [x for x in r.spans.split(",") if x.startswith("term")] for r in pii.pii_table(df).collect()}
    for rows, name in ((far, "quillfeather"), (both, "zanzibar")):
        for i, text in rows:
            at = [k for k in range(len(text)) if text[k:].lower().startswith(name)]
            assert len(at) == 2 and found[i] == [f"term:{k}:{k + len(name)}" for k in at]
    assert all(not found[i] for i, _ in cut + plain)
    clean = {r.doc_id: r.text for r in pii.sanitize(df).collect()}
    assert all("quillfeather" not in clean[i].lower() for i, _ in far) and all("zanzibar" not in clean[i].lower() for i, _ in both)
    assert all(clean[i] == t for i, t in plain)
