import random

from quern.llm import leakage

WORDS = [f"w{i}" for i in range(300)]


def test_runs_against_brute_force(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 13, 30, 60])))) for i in range(25)] + [(90, None), (91, ""), (92, "short one")]
    docs = []
    for d in range(60):
        words = rng.choices(WORDS, k=rng.randrange(40))
        for _ in range(rng.randrange(3)):
            src = (rng.choice(items[:25])[1]).split()
            a = rng.randrange(len(src))
            piece = src[a : a + rng.randrange(8, 40)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = piece
        text = "".join(rng.choice([w, w.upper(), f"<b>{w}</b>", f"{w[:1]}​{w[1:]}", f"*{w}*"]) + rng.choice([" ", "\n", ", ", " ", " &nbsp; "]) for w in words)
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "x" * 100_000), docs[0]]
    clean = lambda t: [w for w in leakage.word_lists([t])[0].as_py() if w]

    def longest(a, b):
        best = 0
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                    k += 1
                best = max(best, k)
        return best

    want = {(d, i) for d, t in docs for i, x in items if longest(clean(t), clean(x)) >= 13}
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, words int")
    ev = spark.createDataFrame([(*r, "q") for r in items + items[:3]], "item_id bigint, item_text string, h string")
    got = leakage.overlaps(df, ev)
    assert {(r.doc_id, r.item_id) for r in got.where("run >= 13").collect()} == want and want
    assert leakage.overlaps(df.limit(0), ev).count() == 0 and leakage.overlaps(df, ev.limit(0)).count() == 0


def test_substitutions_inside_an_overlap(spark):
    item = WORDS[:40]
    passage = list(item)
    for k in (3, 17, 32):
        passage[k] = "changed"
    docs = spark.createDataFrame([(1, "before it " + " ".join(passage) + " after it")], "doc_id bigint, text string")
    ev = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, item_text string")
    r = leakage.overlaps(docs, ev).first()
    assert (r.run, r.words, r.matched, r.doc_pos, r.item_pos) == (14, 36, 34, 6, 4)  # three words before the first substitution do not outweigh it


def test_only_real_tags_are_markup():
    got = leakage.word_lists(["<p class='x'>a</p><br/> <Quote: one two three> if a <b and c> d <a href=\"u v\">e</a>"])[0].as_py()
    assert got == "a quote one two three if a b and c d e".split()


def test_masks_find_passages_with_substitutions():
    """At random substitutions in 10 and 15 % of the words, at least nine of ten passages of 20 words share a seed."""
    rng = random.Random(3)
    masks = [[i for i, bit in enumerate(m) if bit == "1"] for m in leakage.MASKS]
    for share in (0.1, 0.15):
        found = 0
        for _ in range(3000):
            same = [rng.random() >= share for _ in range(20)]
            found += any(all(same[a + i] for i in m) for m in masks for a in range(20 - leakage.SPAN + 1))
        assert found >= 2700
