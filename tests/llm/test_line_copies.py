from __future__ import annotations

from panelmill.llm import line_spread


def test_short_texts_lose_their_footers_and_copies_stay_whole(documents):
    """Nine tenths of a short text may be boilerplate; a document copied to many sites is not."""
    footer = "A long licence footer that is found on every one of the sites"
    copied = "First line of a copied text\nSecond line of it\nThird line of it"
    texts = [f"own {k}\n{footer}" for k in range(12)] + [copied] * 12 + ["Third line of it\n\n" + copied.replace("\nThird line of it", "")]
    texts += [footer, f"{footer}\n\n{footer}"]
    docs = documents(texts, sources=[f"s{k}" for k in range(12)] * 2 + ["s12", "s13", "s14"])
    found = {r["doc_id"]: r for r in line_spread.remove_boilerplate(docs, report=True).collect()}
    assert [found[k]["text"] for k in range(12)] == [f"own {k}" for k in range(12)]
    assert [found[k]["text"] for k in range(12, 27)] == texts[12:] and found[26]["n_removed"] == 0


def test_copies_count_on_one_site_only(documents):
    texts = [f"line\nown {k}" for k in range(9)] + ["line\nsame"] * 5
    docs = documents(texts, sources=[f"s{k}" for k in range(14)])
    assert line_spread.boilerplate_lines(docs, min_sites=11).count() == 0
    assert line_spread.boilerplate_lines(docs, min_sites=10).count() == 1
