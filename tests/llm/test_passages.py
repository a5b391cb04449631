import random

from edgeloom.llm import substring_dedup


def test_unaligned_passages_are_cut_whole(spark):
    """A passage of 51 words begins and ends at any word; the later document loses just that."""
    random.seed(51)
    mark = lambda: random.choice(["", "", "", "", "", "", ".", ",", " -", "\n"])
    words = lambda n, s: [f"{s}{random.randrange(10**6)}{mark()}" for _ in range(n)]
    rows, want = [], {}
    for k in range(150):
        passage, a, b = words(51, "p"), words(random.randrange(70), "a"), words(random.randrange(70), "b")
        rows.append((k, " ".join([*words(random.randrange(70), "c"), *passage, *words(random.randrange(70), "d")])))
        rows.append((1000 + k, " ".join([*a, *passage, *b])))
        want[k], want[1000 + k] = rows[-2][1].split(), [w for x in (a, b) for w in " ".join(x).split()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_repeats(docs).collect()}
    bare = lambda found: {k: [w for w in v if w != "-"] for k, v in found.items()}
    assert bare(got) == bare(want)


def test_every_run_of_ten_words_is_met(spark):
    """Few different words, so that runs repeat by chance, against all runs of all documents."""
    random.seed(10)
    rows = [(k, " ".join(random.choice("ab") for _ in range(60))) for k in range(12)]
    runs = lambda t: [tuple(t.split()[i : i + 10]) for i in range(len(t.split()) - 9)]
    want = {}
    for k, t in rows:
        earlier, seen, cut = {r for _, x in rows[:k] for r in runs(x)}, {}, set()
        for i, r in enumerate(runs(t)):
            if r in earlier or seen.setdefault(r, i) <= i - 10:
                cut |= set(range(i, i + 10))
        want[k] = " ".join(w for i, w in enumerate(t.split()) if i not in cut)
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: t.strip() for k, t in got.items()} == want
