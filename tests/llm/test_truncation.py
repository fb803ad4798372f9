import random

from quire.llm import truncation

NOUNS = "harbour library council reason price hall region paper letter garden window morning".split()
ADJ = "small older quiet narrow bright patient".split()


def sentence(rng):
    a, b = rng.choice(NOUNS), rng.choice(NOUNS)
    return rng.choice([f"The {rng.choice(ADJ)} {a} had replaced the {b} by {rng.randint(1900, 1999)}.", f"Nobody in the {a} expected the {rng.choice(ADJ)} {b} to last.", f"“What of the {a}?” asked the {b}.", f"Was the {a} {rng.choice(ADJ)}, or had the {b} simply changed?"])


def body(rng, tail=None):
    blocks = ["## Chapter"] + [" ".join(sentence(rng) for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, 3))]
    lst = "\n".join(f"- {rng.choice(ADJ)} {rng.choice(NOUNS)}" for _ in range(4))
    if rng.random() < 0.4:
        blocks.insert(rng.randint(1, len(blocks)), lst)
    return "\n\n".join(blocks + ([tail] if tail else []))


def frame(spark, at, bodies):
    rows = [(i, "p%d" % (i % 3) if i % 7 else None, t, at()) for i, t in enumerate(bodies)]
    return spark.createDataFrame(rows, "record_id bigint, provider string, body_md string, written_at timestamp")


def test_cuts_of_all_sorts(spark, at):
    rng = random.Random(5)
    whole = [body(rng) for _ in range(400)] + [body(rng, t) for t in ("| a | b |\n|---|---|\n| hall | 7 |", "*See also: Harbour*", "> The harbour was quiet.\n>\n> — Anna Hall", "```\nhall -> price\n```", "- small harbour\n- older hall") for _ in range(12)]
    cut = []
    for k in range(60):
        t = body(rng, sentence(rng))
        s = t.rindex("\n\n") + 2
        end = s + rng.randint(8, len(t) - s - 3)
        t = t[:end]
        if t.rstrip()[-1] in ".?”":
            t = t.rstrip(".?” ") + " The"
        cut.append(t + rng.choice(["", "", "…", "...", " […]", " **", " [p:3f9", " "]))
    cut += [body(rng, "```\nhall -> pri"), body(rng) + " [p:12ab", body(rng, "| hall | pri")]
    got = {r.record_id: r.cut for r in truncation.cut_records(frame(spark, at, whole + cut)).collect()}
    wrong = [i for i in range(len(whole)) if got[i]]
    missed = [i for i in range(len(whole), len(got)) if not got[i]]
    assert len(wrong) <= 4 and len(missed) <= 2, ([whole[i][-60:] for i in wrong], [cut[i - len(whole)][-60:] for i in missed])


def test_nulls_newest_rows_and_nothing(spark, at):
    rng = random.Random(1)
    df = frame(spark, at, [body(rng) for _ in range(30)])
    extra = spark.createDataFrame([(100, None, None, at()), (101, "p1", "", at()), (102, "p1", " \n", at()), (103, "p1", "…", at()), (104, "p1", "x", at()), (1, "p1", "The old and", at(-5)), (105, "p2", "word " * 50_000, None)], df.schema)
    cuts = truncation.cut_records(df.unionByName(extra).withColumn("cut", df.record_id).withColumn("__latest_rank", df.record_id))
    got = {r.record_id: r for r in cuts.collect()}
    assert len(got) == 36 and not any(got[i].cut for i in (100, 101, 102)) and not got[1].cut and got[105].cut
    assert got[100].log_odds is None
    share = {r.provider: (r.records, r.cut) for r in truncation.by_source(cuts).collect()}
    assert sum(n for n, _ in share.values()) == 36 and None in share
    assert truncation.cut_records(df.limit(0)).count() == 0


def test_blocks_and_endings():
    found, fence = truncation.blocks("# T\n\none\ntwo\n- a\n1. b\n| c |\n> q\n> — n\n```\nx\n```\n*note*")
    assert [k for k, _ in found] == ["heading", "prose", "bullet", "number", "row", "quote", "source", "fence", "fence", "fence", "note"] and not fence
    assert found[1][1] == "one two"
    assert truncation.ending("a [p:3f")[2] and truncation.ending("a **")[2] and truncation.ending("```\nx")[2]
    assert truncation.ending("done. [p:3f-9]")[1:] == (False, False)
    assert truncation.ending("so it went on […]")[:2] == ([("prose", "so it went on")], True)


def test_entries_cut_after_a_whole_word(spark, at):
    """A small table tells open ends of entries as a large one does."""
    rng = random.Random(9)
    whole = [body(rng) for _ in range(300)] + [body(rng, f"- {rng.choice(ADJ)} {rng.choice(NOUNS)}\n- {rng.choice(ADJ)} {n}") for n in NOUNS] + [body(rng, "- hall (town)\n- older price (quiet)")]
    cut = [body(rng, f"- small price\n{mark} {tail}") for mark, tail in (("-", "ancestor and"), ("*", "price of the"), ("-", "older"), ("1.", "quiet"), ("-", "careful problem (Grulavale"), ("-", "small"))] + [body(rng, "> The harbour was quiet.\n>\n> — Anna Hall, The")]
    got = {r.record_id: r.cut for r in truncation.cut_records(frame(spark, at, whole + cut)).collect()}
    assert [i for i in range(len(whole), len(got)) if not got[i]] == []
    assert sum(got[i] for i in range(len(whole))) <= 3 and not any(got[i] for i in range(300, len(whole)))
