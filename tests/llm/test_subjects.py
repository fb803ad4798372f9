import random

from quire.llm import subjects

FILL = "Nobody expected the pledge to last, and the readers of the account said so before the end of it.".split()


def doc(rng, parts, words=120, lang="en"):
    terms = [rng.choice(subjects.CURATED[lang][s].split()) for s, n in parts for _ in range(n)]
    fill = {"en": FILL, "fr": "Le chapitre reprend la question que le lecteur a laissée et ne dit rien de plus sur elle".split()}[lang]
    out = [rng.choice(fill) for _ in range(max(0, words - len(terms)))] + terms
    rng.shuffle(out)
    return " ".join(out) + "."


def frames(spark, rows, labels=()):
    d = spark.createDataFrame(rows, "doc_id bigint, text string, subject string")
    s = spark.createDataFrame([(x.capitalize(), "about") for x in subjects.SUBJECTS], "subject string, description string")
    l = spark.createDataFrame(list(labels), "doc_id bigint, subject string")
    return d, s, l


def found(spark, rows, labels=()):
    got = {}
    for r in subjects.subjects_of(*frames(spark, rows, labels)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_subjects(spark):
    rng = random.Random(4)
    base = [(1_000 + i, doc(rng, [(rng.choice(subjects.SUBJECTS), 14)]), None) for i in range(120)]
    rows = base + [
        (1, doc(rng, [("law", 14)]), "x"),
        (2, doc(rng, [("law", 14), ("music", 10)]), "x"),
        (3, doc(rng, [("law", 30), ("music", 2)]), "x"),
        (4, doc(rng, []), "x"),
        (5, doc(rng, [("medicine", 12)], lang="fr"), "x"),
        (6, None, "x"),
        (7, "", "x"),
        (8, " \n", "x"),
        (9, doc(rng, [("sport", 1)], words=600), "x"),
        (None, doc(rng, [("cooking", 14)]), "x"),
        (10, doc(rng, [("history", 4_000)], words=60_000), "x"),
    ]
    got = found(spark, rows)
    assert {i: got.get(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, None, 10)} == {1: {"Law"}, 2: {"Law", "Music"}, 3: {"Law"}, 4: None, 5: {"Medicine"}, 6: None, 7: None, 8: None, 9: None, None: {"Cooking"}, 10: {"History"}}


def test_calibration_by_labels(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(260):
        a, b = rng.sample(subjects.SUBJECTS, 2)
        both = i % 2
        rows.append((i, doc(rng, [(a, 20), (b, 12 if both else 5)]), None))
        labels += [(i, a.upper() + " "), (i, a)] + ([(i, b)] if both else [])
    got = found(spark, rows, labels)
    right = sum(len(got[i]) == (2 if i % 2 else 1) for i in range(260))
    assert right >= 240


def test_calibration_takes_all_labels(spark):
    # labels that favour no threshold by much, so that a part of them would give another
    rng = random.Random(6)
    scored, labels = [], [(None, "law"), (3, "astrology")]
    for i in range(8_000):
        ratio = rng.randrange(8, 47) / 100 + 0.005
        hits = rng.choice([2.0, 4.5, 9.0])
        both = rng.random() < 0.5
        wrong = rng.random() < 0.1
        scored += [(i, "law", 20.0, 1.0), (i, "music", hits, ratio)]
        labels += [(i, "sport" if wrong else "Law "), (i, "sport" if wrong else "law")] + ([(i, "MUSIC")] if both else [])
    labelled = {(i, s.strip().lower()) for i, s in labels}
    told = [(ratio, (i, s) in labelled) for i, s, hits, ratio in scored if ratio < 1.0 and hits >= subjects.FURTHER_HITS and (i, "law") in labelled]
    grid = [k / 100 for k in range(10, 45)]
    errors = [sum((ratio >= x) != label for ratio, label in told) for x in grid]
    assert errors.count(min(errors)) == 1
    got = subjects.calibrate(spark.createDataFrame(scored, "doc_id bigint, subject string, hits double, ratio double"), spark.createDataFrame(labels, "doc_id bigint, subject string"))
    assert got == grid[errors.index(min(errors))]


def test_terms_are_learned(spark):
    rng = random.Random(3)
    rows = [(i, doc(rng, [("music", 10)]) + " zither", None) for i in range(30)] + [(100 + i, doc(rng, [("law", 10)]), None) for i in range(30)]
    d, _, _ = frames(spark, rows)
    learned = {(t, s) for lang, t, s, _ in subjects.learn_terms(d) if lang == "en"}
    assert ("zither", "music") in learned and not any(t == "pledge" for t, _ in learned)


def test_word_boundaries():
    m = subjects.Matcher([("en:cell", 0), ("en:key", 1)])
    assert dict(m.count("cells, a cell; excellent keyed key-ring key", "en")) == {0: 2, 1: 1}


def test_nothing(spark):
    d, s, l = frames(spark, [(1, "x", None)])
    assert subjects.subjects_of(d.limit(0), s, l).count() == 0
    assert subjects.subjects_of(d, s.limit(0), l).count() == 0
    c = subjects.composition(subjects.subjects_of(*frames(spark, [(1, "jury tribunal lawsuit statute", None)]))).collect()
    assert [(r.subject, r.documents, r.share) for r in c] == [("Law", 1, 1.0)]
