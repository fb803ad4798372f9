import pytest

from quire.llm import quality

PROSE = [
    "Nobody in the town expected the harbour to last beyond the war, and the council had said so for years.",
    "What matters is the reason, not the price around it! Two readers of the paper asked for a better one.",
    "By 1942 the small library had replaced the older hall.\nIt was the first of its kind in the region, and it\nstood for what the people wanted.",
    "Der Hafen war schon lange geschlossen, und niemand in der Stadt hat sich darum noch gekümmert.",
]
OTHER = {
    "- small harbour\n- price and reason\n- older hall (Norden)": "list",
    "(1) small harbour\n(2) older library\n(3) council": "list",
    "harbour and hall; small library; older council (Norden); price and reason": "list",
    "Small harbour ........ 12\nOlder library .... 30\nCouncil and price ...... 44": "list",
    "harbour, 12, 130–135\nlibrary, 4, 101–110\ncouncil, 9, 20": "list",
    "Town | Year | Share\nNorden | 1942 | 12.5%\nSüden | 1950 | 7%": "table",
    "Town\tYear\nNorden\t1942\nSüden\t": "table",
    "Town;Year;Share\nNorden;1942;12.5%\nSüden;1950;7%": "table",
    "Town        Year      Share\nNorden      1942      12.5%\nSüden       1950      7%": "table",
    "Town  Year  Share  Norden  1942  12.5%  Süden  1950  7%": "table",
    "[empty table]": "table",
    "| | |\n|---|---|": "table",
    "qzxv wkjq pfgth zzkq vxw jqkx bvcxz hgfqw": "junk",
    "_\\#]*+¤ %¤@ _{§=@ +{ ]+>=@}": "junk",
    "RHg4VGVkKQqOtQFj6zv2kHDeyh28116VLEuZpvxSzwAtGiblBlymFNqd7TW0Z1xPOxnWcJCetbCmgXp3fB1gY7q7A==": "junk",
    "Ã¶â€˜kkk10 Ã¤â€™jjBD Ã¶â€˜kkk9B ÃŸâ€œz56": "junk",
    '<span class="c1"></span><span class="c2"><br/></span><span>&nbsp;</span>': "junk",
    "----------------1234 ============99 ______________77": "junk",
    "e l o p f | . ' t r n i h g I 1 : s d": "junk",
}


def rows(paragraphs, texts):
    # the corpus that says how words look
    return paragraphs([(1_000 + i, t) for i, t in enumerate(PROSE * 60)] + [(i, t) for i, t in enumerate(texts)])


def test_kinds(spark, paragraphs):
    texts = [*OTHER, *PROSE, "THE OLDER HARBOUR  7\nWhat matters is the reas-\non, not the price around it.", None, "", " \n\t"]
    got = {r.record_id: r.kind for r in quality.text_quality(rows(paragraphs, texts)).filter("record_id < 1000").collect()}
    assert {t: got[i] for i, t in enumerate(texts) if t in OTHER} == OTHER
    assert [got[i] for i in range(len(OTHER), len(texts))] == ["prose"] * 5 + [None] * 3


def test_statistics_and_newest_row(spark, paragraphs, at):
    df = paragraphs([{"record_id": 1, "text": "The hall, the end."}, {"record_id": 1, "text": "old", "ingested_at": at(-1)}, {"record_id": 1, "text": "The hall, the end."}, {"record_id": None, "text": "a"}, {"record_id": 2, "text": None, "ingested_at": None}])
    got = {r.record_id: r for r in quality.text_quality(df).collect()}
    r = got[1]
    assert (r.n_words, r.mean_word_length, r.punctuated_lines, r.common_words) == (4, 15 / 4, 1.0, 0.5)
    assert r.symbol_ratio == pytest.approx(2 / 18) and got[2].n_words == 0 and got[2].kind is None and got[None].n_words == 1
    assert quality.text_quality(df.limit(0)).count() == 0


def test_very_long_text(spark, paragraphs):
    df = rows(paragraphs, [" ".join(PROSE * 2_000), "x" * 300_000, "\n".join(["- older hall"] * 20_000)])
    got = {r.record_id: r.kind for r in quality.text_quality(df).filter("record_id < 1000").collect()}
    assert got == {0: "prose", 1: "junk", 2: "list"}


def test_divergence_is_zero_for_the_profile():
    import numpy as np

    p = np.array([[0.2, 0.3, 0.5]])
    assert quality.divergences(p, p)[0, 0] == pytest.approx(0.0, abs=1e-12)
    assert quality.divergences(np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]]))[0, 0] == pytest.approx(1.0)
