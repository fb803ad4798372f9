"""Problem 8: the subject areas of each document.

Curated terms are matched with a multi-pattern automaton. All documents that
the curated terms place clearly give further terms, and both kinds the weight
they have for each subject; term rarity comes from all documents. A
document is about its strongest subject where that is dense enough, and about
each further one that comes near enough to it; all hand labels calibrate how
near.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm.language import ALL_FUNCTION_WORDS, detect
from quire.session import materialize

#: Curated terms by language and subject (fixed values).
CURATED: dict[str, dict[str, str]] = {
    "en": {
        "science": "electron photon molecule enzyme genome telescope isotope neutron glacier fossil hypothesis laboratory chromosome polymer bacterium quasar spectrum microscope wavelength sediment",
        "law": "plaintiff defendant tribunal jury statute barrister lawsuit injunction affidavit tort jurisdiction prosecutor magistrate testimony arbitration clause lease liability judge covenant",
        "sport": "goalkeeper referee stadium tournament midfield striker marathon sprint trophy league umpire podium javelin relay playoff regatta wicket hurdle racket scoreboard",
        "software": "compiler debugger database server module parser kernel cache refactoring deployment repository endpoint query pointer bug scheduler thread backup interface protocol",
        "economics": "inflation tariff currency dividend mortgage recession investor deficit subsidy monopoly tax wage market trade loan surplus bond productivity price bank",
        "medicine": "surgeon vaccine diagnosis antibody kidney artery fever infection biopsy placebo prescription scalpel clinic nurse tumour insulin stethoscope epidemic dose anaesthetic",
        "history": "monarch treaty empire dynasty crusade siege fortress peasant guild duchy manuscript armistice colony chronicle garrison regiment revolution century abbey republic",
        "cooking": "oven recipe flour dough butter garlic onion broth casserole pastry vinegar marinade whisk stew saucepan skillet yeast basil custard pepper",
        "psychology": "cognition emotion anxiety empathy ego trauma memory perception temperament subconscious heuristic motivation impulse introspection bias attachment conditioning personality stimulus intuition",
        "music": "violin orchestra melody sonata chord tempo symphony soprano choir quartet aria fugue cadence trumpet piano rhythm overture ballad harmony refrain",
    },
    "de": {
        "science": "elektron photon molekül enzym teleskop labor membran wellenlänge fossil",
        "law": "klage richterin gericht haftung zeugin klausel kaution satzung urteil",
        "sport": "stadion turnier schiedsrichter tribüne torwart marathon saison läuferin strafstoßregel",
        "software": "datenbank schnittstelle schleife variable repositorium abfrage modul laufzeit fehlersuche",
        "economics": "inflation währung steuer darlehen defizit dividende anleihe rezession ausfuhr",
        "medicine": "niere arterie fieber narkose impfung infektion dosis klinik chirurgin",
        "history": "herzogtum belagerung dynastie kaiserreich festung kloster zunft garnison handschrift",
        "cooking": "hefe zitrone sahne soße pfanne zwiebel brühe gewürz teig",
        "psychology": "angst gedächtnis wahrnehmung bindung aufmerksamkeit erinnerung persönlichkeit verzerrung gefühl",
        "music": "orchester sonate tonleiter trommel quartett ouvertüre geige melodie dirigentin",
    },
    "fr": {
        "science": "électron photon molécule enzyme télescope laboratoire membrane fossile spectre",
        "law": "juge tribunal procureur jurisprudence plainte avocat bail verdict contrat",
        "sport": "gardien stade arbitre tournoi raquette entraîneur peloton podium marathon",
        "software": "serveur compilateur pointeur boucle bogue correctif analyseur variable dépôt",
        "economics": "monnaie impôt déficit dette salaire tarif exportation inflation marché",
        "medicine": "vaccin chirurgien infirmière fièvre artère tumeur fracture clinique diagnostic",
        "history": "duché garnison traité abbaye manuscrit colonie empire révolution chronique",
        "cooking": "farine beurre bouillon vinaigre levure crème ragoût casserole pâte",
        "psychology": "mémoire anxiété émotion empathie intuition peur stress attention perception",
        "music": "violon mélodie orchestre sonate trompette chœur gamme soprano tambour",
    },
    "es": {
        "science": "telescopio molécula célula enzima electrón fotón laboratorio fósil glaciar",
        "law": "juez tribunal cláusula contrato fiscal abogada veredicto jurisprudencia fianza",
        "sport": "portero estadio torneo árbitro raqueta pelotón maratón penalti entrenadora",
        "software": "servidor compilador puntero bucle repositorio analizador parche variable interfaz",
        "economics": "inflación deuda arancel impuesto salario moneda déficit ahorro exportación",
        "medicine": "vacuna fiebre arteria cirujano enfermera riñón fractura clínica diagnóstico",
        "history": "ducado imperio asedio abadía manuscrito colonia dinastía guarnición tratado",
        "cooking": "horno sartén harina mantequilla caldo vinagre especia guiso ajo",
        "psychology": "ansiedad emoción empatía atención miedo sesgo intuición motivación percepción",
        "music": "violín orquesta melodía sonata coro trompeta acorde armonía tambor",
    },
}
SUBJECTS = tuple(CURATED["en"])

#: A document teaches terms if it has so many curated ones and so much of them on one subject.
CLEAR_HITS, CLEAR_SHARE = 5, 0.8
#: A word becomes a term if the lower bound of its share on one subject is at least this, and if such a part of all clear documents of its language has it, but no fewer than six. So the terms are as many as the vocabulary allows at most, whatever the corpus.
TERM_SHARE, TERM_PART, TERM_DOCS = 0.5, 2e-4, 6
#: Clear documents that speak for a curated term before any are counted.
CURATED_DOCS = 10.0
#: Weighted terms a word that the strongest subject of a document has at least, and weighted terms that any further one has.
DENSITY, FURTHER_HITS = 0.0085, 4.5
#: What a further subject has of the strongest one's evidence at least, where too few labels are there to calibrate it.
RATIO = 0.22
ENOUGH_LABELS = 150

_WORD = regex.compile(r"[\p{L}\p{M}]+(?:[-'’][\p{L}\p{M}]+)*")


def curated() -> list[tuple[str, str, str, float]]:
    return [(lang, term, s, 1.0) for lang, by in CURATED.items() for s, terms in by.items() for term in terms.split()]


class Matcher:
    """Counts terms of a language at word boundaries with one automaton a language."""

    def __init__(self, terms: list[tuple[str, int]]):
        """``terms``: (``language:term``, number)."""
        self.of: dict[str, ahocorasick.Automaton] = {}
        for name, number in terms:
            lang, _, term = name.partition(":")
            a = self.of.setdefault(lang, ahocorasick.Automaton())
            a.add_word(term, (len(term), number))
        for a in self.of.values():
            a.make_automaton()

    def count(self, low: str, lang: str) -> Counter:
        """Occurrences by term number in a lower-case text; a plural s may follow a term."""
        out: Counter = Counter()
        a = self.of.get(lang)
        if a is None:
            return out
        n = len(low)
        for end, (size, number) in a.iter(low):
            first = end - size
            if first >= 0 and (low[first].isalnum() or low[first] == "-"):
                continue
            after = end + 1
            if after < n and low[after] == "s":
                after += 1
            if after < n and (low[after].isalnum() or (low[after] == "-" and after + 1 < n and low[after + 1].isalpha())):
                continue
            out[number] += 1
        return out


def _language(low: str) -> tuple[str, int]:
    words = low.replace("'", " ").replace("’", " ").split()
    return detect(words), len(words)


def _teach(df: DataFrame, terms: list[tuple[str, str, str, float]]) -> DataFrame:
    """(lang, word, subject, n): in how many clear documents of a subject a word stands, each task adding up its own; the empty word stands in all."""
    subject_of = {i: s for i, (_, _, s, _) in enumerate(terms)}
    numbered = [(f"{lang}:{t}", i) for i, (lang, t, _, _) in enumerate(terms)]

    def told(seen: Counter) -> pa.RecordBatch:
        rows = [(*k, n) for k, n in seen.items()]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "word", "subject", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(numbered)
        seen: Counter = Counter()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                for text in batch.slice(k, 256).column(0).to_pylist():
                    low = text.lower()
                    lang, _ = _language(low)
                    hits: Counter = Counter()
                    for t, n in m.count(low, lang).items():
                        hits[subject_of[t]] += n
                    if not hits:
                        continue
                    (best, n), total = hits.most_common(1)[0], sum(hits.values())
                    if n < CLEAR_HITS or n < CLEAR_SHARE * total:
                        continue
                    seen.update((lang, w, best) for w in set(_WORD.findall(low)) if 2 < len(w) < 30)
                    seen[lang, "", best] += 1
            if len(seen) > 500_000:
                yield told(seen)
        if seen:
            yield told(seen)

    return df.select("text").mapInArrow(run, "lang string, word string, subject string, n bigint")


def learn_terms(docs: DataFrame) -> list[tuple[str, str, str, float]]:
    """Curated terms and those that all documents add: (language, term, subject, weight).

    The weight is the share of a term's clear documents that are on the
    subject; for a curated term on its own subject some are taken for granted.
    A term may belong to more than one subject.
    """
    terms = curated()
    taught = _teach(docs.filter("text is not null"), terms).groupBy("lang", "word", "subject").agg(F.sum("n").alias("n"))
    by_word = materialize(taught.groupBy("lang", "word").agg(F.sum("n").alias("docs"), F.collect_list(F.struct("subject", "n")).alias("by")), "subject-words")
    # one row a language
    of_lang = {r["lang"]: r["docs"] for r in by_word.filter("word = ''").collect()}
    least = F.lit(float(TERM_DOCS))
    for lang, n in of_lang.items():
        least = F.when(F.col("lang") == lang, max(float(TERM_DOCS), n * TERM_PART)).otherwise(least)
    share = F.col("x.n") / F.col("docs")
    z = 1.64
    lower = (share + z * z / (2 * F.col("docs")) - z * F.sqrt(share * (1 - share) / F.col("docs") + z * z / (4 * F.col("docs") * F.col("docs")))) / (1 + z * z / F.col("docs"))
    own = {(lang, t): s for lang, t, s, _ in terms}
    known = F.col("word").isin(sorted({t for _, t in own}))
    rows = by_word.filter((F.col("word") != "") & (known | (F.col("docs") >= least))).withColumn("x", F.explode("by")).select("lang", "word", "docs", known.alias("known"), "x.subject", F.col("x.n").alias("n"), share.alias("share"), lower.alias("lower"))
    best = rows.withColumn("best", F.max("lower").over(_by("lang", "word"))).filter(F.col("known") | ((F.col("best") >= TERM_SHARE) & (F.col("share") >= 0.2)))
    added: list[tuple[str, str, str, float]] = []
    counts: dict[tuple[str, str], tuple[int, int]] = {}
    for r in best.collect():
        if (r.lang, r.word) in own:
            if r.subject == own[r.lang, r.word]:
                counts[r.lang, r.word] = r.n, r.docs
        elif r.best >= TERM_SHARE and r.share >= 0.2 and r.docs >= max(TERM_DOCS, of_lang.get(r.lang, 0) * TERM_PART) and r.word not in ALL_FUNCTION_WORDS:
            added.append((r.lang, r.word, r.subject, float(r.share)))
    weighted = [(lang, t, s, (counts.get((lang, t), (0, 0))[0] + CURATED_DOCS) / (counts.get((lang, t), (0, 0))[1] + CURATED_DOCS)) for lang, t, s, _ in terms]
    return weighted + sorted(added)


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def match_terms(docs: DataFrame, terms: list[tuple[str, str, str, float]]) -> DataFrame:
    """(doc_id, n_words, hits array<struct<term int, n int>>) for every document with a term; the only pass over the texts."""
    names = sorted({f"{lang}:{t}" for lang, t, _, _ in terms})
    numbered = [(t, i) for i, t in enumerate(names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(numbered)
        hit = pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int32())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                rows = []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not text:
                        continue
                    low = text.lower()
                    lang, n_words = _language(low)
                    found = m.count(low, lang)
                    if found:
                        rows.append((i, n_words, [{"term": t, "n": n} for t, n in found.items()]))
                if rows:
                    ids, n, hits = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int32()), pa.array(hits, hit)], names=["doc_id", "n_words", "hits"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, n_words int, hits array<struct<term int, n int>>")


def _scores(hits: list[tuple[int, int]], n_words: int, weights: dict[int, dict[str, float]], rarity: dict[int, float]) -> list[tuple[str, float, float, float]]:
    """(subject, hits, density, ratio) of one document, the strongest subject first.

    A term of several subjects is first divided by its weights alone, then in
    proportion to what the document has of each.
    """
    have = dict.fromkeys(SUBJECTS, 1.0)
    for _ in range(3):
        count: dict[str, float] = {}
        evidence: dict[str, float] = {}
        for term, n in hits:
            w = weights[term]
            if len(w) == 1:
                parts = w
            else:
                total = sum(x * have.get(s, 0.0) for s, x in w.items())
                scale = sum(w.values()) / total if total else 0.0
                parts = {s: x * have.get(s, 0.0) * scale for s, x in w.items()}
            for s, x in parts.items():
                count[s] = count.get(s, 0.0) + n * x
                evidence[s] = evidence.get(s, 0.0) + n * x * rarity[term]
        have = evidence
    top = max(evidence.values())
    order = sorted(evidence, key=lambda s: (-evidence[s], s))
    return [(s, count[s], evidence[s] / max(20, n_words), evidence[s] / top) for s in order if top > 0]


def score(matched: DataFrame, terms: list[tuple[str, str, str, float]], n_docs: int) -> DataFrame:
    """(doc_id, subject, hits, density, ratio, strongest): weighted terms of each subject a document has any of; the density of its strongest one.

    A term counts its weight for the subject times its rarity,
    log(documents / those with it) over log(documents), 0.3 at least. Density
    is that a word of the document, ratio that against its strongest subject.
    """
    names = {t: i for i, t in enumerate(sorted({f"{lang}:{t}" for lang, t, _, _ in terms}))}
    weights: dict[int, dict[str, float]] = {}
    for lang, t, subject, w in terms:
        weights.setdefault(names[f"{lang}:{t}"], {})[subject] = w
    # one row a term: no more than the terms that were handed in
    docs_with = matched.select(F.explode("hits.term").alias("term")).groupBy("term").count().collect()
    scale = math.log(max(2, n_docs))
    rarity = {r["term"]: max(0.3, math.log(max(2, n_docs) / r["count"]) / scale) for r in docs_with}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "subject", "hits", "density", "ratio", "strongest"]
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            rows = [
                (i, *x, told[0][2])
                for i, n, hits in zip(*(batch.column(c).to_pylist() for c in range(3)))
                for told in [_scores([(h["term"], h["n"]) for h in hits], n, weights, rarity)]
                for x in told
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return matched.select("doc_id", "n_words", "hits").mapInArrow(run, "doc_id bigint, subject string, hits double, density double, ratio double, strongest double")


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The ratio threshold that fits all labelled documents best.

    Labels are trimmed and folded to lower case, repeated ones count once.
    Documents whose labels leave out their strongest subject are taken for
    mislabelled. Of thresholds that fit equally well the middle one is taken.
    With fewer than ``ENOUGH_LABELS`` the default stays.
    """
    clean = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).filter(F.col("subject").isin(*SUBJECTS) & F.col("doc_id").isNotNull()).distinct()
    if clean.count() < ENOUGH_LABELS:
        return RATIO
    labelled = clean.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    strongest, further = F.col("ratio") == 1.0, (F.col("ratio") < 1.0) & (F.col("hits") >= FURTHER_HITS)
    told = scored.filter(strongest | further).join(labelled, "doc_id").select("doc_id", "ratio", F.array_contains("labels", F.col("subject")).alias("label"))
    right = told.withColumn("wrong", F.max(strongest & ~F.col("label")).over(_by("doc_id"))).filter(~F.col("wrong") & (F.col("ratio") < 1.0))
    grid = [k / 100 for k in range(10, 45)]
    reached = sum(((F.col("ratio") >= x).cast("int") for x in grid), F.lit(0))
    # how many thresholds a subject reaches and whether it is a label: 72 rows at most
    counts = right.groupBy(reached.alias("reached"), "label").agg(F.count("*").alias("n")).collect()
    errors = [sum(r.n for r in counts if (r.reached > k) != r.label) for k in range(len(grid))]
    good = [x for x, n in zip(grid, errors) if n == min(errors)]
    return good[len(good) // 2]


def subjects_of(docs: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, hits, density, ratio) for each subject a document is about.

    Null, empty and blank texts, and texts with no term, have no row; a
    subject under the thresholds is only
    mentioned in passing. Subjects are spelled as in ``subjects``, others are
    not assigned. Texts of any length are matched whole; the stated language
    is not used. Rows that repeat a doc_id are
    a document each. An empty frame gives an empty frame.
    """
    docs = docs.select("doc_id", "text")
    terms = learn_terms(docs)
    matched = materialize(match_terms(docs, terms), "subject-terms")
    scored = materialize(score(matched, terms, docs.count()), "subject-scores")
    ratio = calibrate(scored, labels)
    # of the names in the table only those the curated terms know: ten rows at most
    spelled = subjects.filter(F.lower(F.trim("subject")).isin(*SUBJECTS)).groupBy(F.lower(F.trim("subject")).alias("low")).agg(F.min("subject").alias("spelled"))
    said = scored.filter((F.col("strongest") >= DENSITY) & ((F.col("ratio") == 1.0) | ((F.col("ratio") >= ratio) & (F.col("hits") >= FURTHER_HITS))))
    return said.join(F.broadcast(spelled), F.col("subject") == F.col("low")).select("doc_id", F.col("spelled").alias("subject"), "hits", "density", "ratio")


def composition(assigned: DataFrame) -> DataFrame:
    """(subject, documents, share): a document on several subjects counts for each in equal parts."""
    n = F.count("*").over(_by("doc_id"))
    parts = assigned.select("subject", "doc_id", (F.lit(1.0) / n).alias("part"))
    by = parts.groupBy("subject").agg(F.count("*").alias("documents"), F.sum("part").alias("parts"))
    # one row a subject, so few that one task may hold them
    return by.select("subject", "documents", (F.col("parts") / F.sum("parts").over(_by())).alias("share"))
