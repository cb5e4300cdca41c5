import random
import re
from fractions import Fraction

import corpus_pipeline
from tests.llm.helpers import AWKWARD, frame, input_dir, labels
from ventura.llm import ngram_jaccard as J

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, n, t):
    """Components and set sizes; rows of one id are one node."""
    sets = []
    for i, text in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and i is not None and j is not None and both * t.denominator >= t.numerator * (len(x) + len(y) - both):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def copies(seed, first, families, members, words, edits):
    """Families of near copies, some of them chains, and texts that share a long passage."""
    rng = random.Random(seed)
    out = []
    passage = [f"p{k}" for k in range(40)]
    for f in range(families):
        base = [f"f{first}x{f}w{k}" for k in range(words)] + passage
        for _ in range(members):
            own = list(base)
            for _ in range(rng.randint(0, edits)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            out.append((first + len(out), " ".join(own).title() if rng.random() < 0.2 else " ".join(own)))
    rng.shuffle(out)
    return out


#: Sets on either side of the thresholds: 21 words, one end word changed (18 of 20 shingles of three), one inner word.
W = [f"w{k}" for k in range(21)]
SHARP = [(601, " ".join(W)), (602, " ".join([*W[:-1], "x"])), (603, " ".join([*W[:10], "y", *W[11:]]))]
TEXTS = AWKWARD + SHARP + copies(1, 700, 6, 12, 120, 3) + copies(3, 1000, 1, 110, 150, 4)


def test_links_at_the_contract(spark, tmp_path):
    got = J.op8_ngram_jaccard(spark, input_dir(spark, tmp_path, frame(spark, TEXTS)))
    assert found(got) == brute(TEXTS, 3, Fraction(9, 10))


def test_links_at_the_default(spark):
    assert found(J.link_components(frame(spark, TEXTS))) == brute(TEXTS, 5, Fraction(4, 5))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in J.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_empty(spark, tmp_path):
    assert J.op8_ngram_jaccard(spark, input_dir(spark, tmp_path, frame(spark, []))).count() == 0


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(5)
    clean = [(i, " ".join(f"word{rng.randrange(5000)}" for _ in range(80))) for i in range(40)]
    near = clean[7][1].split()
    near[40] = "changed"
    texts = clean + [(100, " ".join(near)), (101, clean[8][1]), (102, "short text"), (103, "a b c d e " * 30), (104, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCUMENTS)
    d = input_dir(spark, tmp_path, docs, labels(spark, []))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, d)
        assert kept.columns == docs.columns, name
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {i for i, _ in clean} and ids.isdisjoint({100, 102, 103, 104})
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r["doc_id"] for r in rows} == ids


def test_pipeline_on_an_empty_table(spark, tmp_path):
    d = input_dir(spark, tmp_path, spark.createDataFrame([], DOCUMENTS), labels(spark, []))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_pipeline_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "line_dedup", "near_duplicates", "packing"]


def test_sets_of_few_words():
    from ventura.llm.hashing import ShingleHasher

    for k in range(7):
        made = [len(x) for x in ShingleHasher(5).sets([" ".join("abcdefg"[:k]), None, "x y"])]
        assert made == [max(k - 4, 1) if k else 0, 0, 1]


#: Two words that polynomial hashes modulo 2**64 give one value, whatever the base.
PARITY = "".join("ab"[i.bit_count() % 2] for i in range(1024))
COLLIDING = (PARITY, PARITY.translate(str.maketrans("ab", "ba")))


def test_colliding_words(spark):
    texts = [(1, f"p q {COLLIDING[0]}"), (2, f"p q {COLLIDING[1]}"), (3, COLLIDING[0]), (4, COLLIDING[1]), (5, COLLIDING[1])]
    assert found(J.link_components(frame(spark, texts), 3, Fraction(9, 10))) == brute(texts, 3, Fraction(9, 10))


def test_a_family_of_copies_between_close_and_linked(spark):
    """Near copies with so many edits that many pairs just don't link, chains of small steps, and one id with two texts."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for i in range(300):
        own = list(base)
        for k in rng.sample(range(200), rng.randint(1, 9)):
            own[k] = f"e{rng.randrange(10**7)}"
        texts.append((i, " ".join(own)))
    step = [f"c{k}" for k in range(200)]
    for i in range(40):
        step = step[3:] + [f"c{200 + 3 * i + k}" for k in range(3)]
        texts.append((1000 + i, " ".join(step)))
    texts += [(1020, "another text of the same id with words of its own"), (2000, "another text of the same id with words of its own"), (2000, " ".join(step))]
    for n, t in ((3, Fraction(9, 10)), (5, Fraction(4, 5))):
        assert found(J.link_components(frame(spark, texts), n, t)) == brute(texts, n, t)


def test_long_texts_of_different_bitmaps(spark):
    """Sets around a size where the bitmap doubles, linked and not."""
    words = [f"w{k}" for k in range(4300)]
    texts = [(1, " ".join(words[:4000])), (2, " ".join(words[:4200])), (3, " ".join(words[50:4300])), (4, " ".join(words[2000:])), (5, " ".join(reversed(words)))]
    assert found(J.link_components(frame(spark, texts), 3, Fraction(9, 10))) == brute(texts, 3, Fraction(9, 10))


def test_components_of_stars_and_loose_ends(spark):
    """Hubs with many leaves, some smaller than the hub, a ring between hubs, pairs."""
    links = [(500, k) for k in range(1, 90)] + [(600, 700 + k) for k in range(50)] + [(600, 900), (900, 950), (950, 600), (2000, 2001), (3000, 3001), (3001, 3002), (3002, 3003)]
    got = {r["node"]: r["root"] for r in J.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {500: 1} | {k: 1 for k in range(2, 90)} | {700 + k: 600 for k in range(50)} | {900: 600, 950: 600, 2001: 2000, 3001: 3000, 3002: 3000, 3003: 3000}
    assert got == want


def near(seed, first, count, words, edits, shared=()):
    """Texts of one base with up to ``edits`` words replaced, some of them by one of the words ``shared``, or cut off."""
    rng = random.Random(seed)
    out = []
    for i in range(count):
        own = [f"n{first}w{k}" for k in range(words)]
        for k in rng.sample(range(words), rng.randint(0, edits)):
            own[k] = rng.choice(shared) if shared and rng.random() < 0.5 else f"e{rng.randrange(10**9)}"
        out.append((first + i, " ".join(own[: words - rng.choice((0, 0, 0, 1, 3))])))
    return out


def test_links_of_all_sizes_and_thresholds(spark):
    """Short and long texts, families with many members on either side of the threshold, and equal sets; thresholds with parts and without."""
    rng = random.Random(31)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for i in range(60)]
    for f, words in enumerate((5, 6, 9, 12, 16, 25, 40)):
        texts += near(f, 1000 * (f + 1), 14, words, 2)
    texts += near(40, 20000, 80, 90, 9, ["x", "y"]) + near(41, 30000, 60, 250, 20, [f"s{k}" for k in range(6)])
    for n, t in ((3, Fraction(9, 10)), (3, Fraction(1, 2)), (2, Fraction(4, 5))):
        assert found(J.link_components(frame(spark, texts), n, t)) == brute(texts, n, t), (n, t)


def most_paired(spark, texts):
    """Most rows that one join, or one generator of pairs, makes for these texts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    J.link_components(frame(spark, texts), 3, Fraction(9, 10)).collect()
    made = {}
    runs = store.executionsList()
    for run in (runs.apply(k).executionId() for k in range(runs.size())):
        if run < before:
            continue
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            for metric in (node.metrics().apply(k) for k in range(node.metrics().size())):
                value = values.get(metric.accumulatorId())
                pairs = "Join" in node.name() or re.search(r"explode\(([xy]s|delta)", node.desc())
                if pairs and metric.name() == "number of output rows" and value.isDefined():
                    name = re.sub(r"#\d+L?", "", node.desc())
                    made[name] = made.get(name, 0) + int(value.get().replace(",", ""))
    return max(v for k, v in made.items() if "explode(xs)" in k or "explode(" not in k)


def test_phrases_of_unrelated_texts_make_no_pairs(spark):
    """Texts of few words share most phrases; their pairs are no more for it."""
    rng = random.Random(3)
    texts = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(80))) for i in range(1000)]
    assert most_paired(spark, texts) <= 3000


def test_pairs_of_a_family_grow_with_it(spark):
    """Near copies of which many don't link with any other: four times as many make few times as many rows."""
    few, many = (most_paired(spark, near(5, 0, count, 400, 20)) for count in (150, 600))
    assert many <= 8 * few


def test_hubs_that_follow_a_larger_one_pass_their_nodes_on(spark):
    """A node whose component of most lists has a hub itself, of more nodes, follows that one."""
    roots = spark.createDataFrame([(k, 1) for k in range(2, 7)] + [(10, 9), (11, 9)], "node long, root long")
    members = {100: [9, 1, 2, 3, 4, 30, 31, 32], 101: [9, 10, 11, 20, 21], 102: [9, 1, 2, 30]}
    lists = spark.createDataFrame([(t, i, 0, 8, 1) for t, ids in members.items() for i in ids], "token long, id long, salt int, n long, salts int")
    join = J._Join(None, lists.select("id").distinct(), lists, 3, Fraction(9, 10))
    join.roots = roots
    assert {(r["a"], r["b"]) for r in join.hub_pairs().collect()} == {(k, 1) for k in (2, 3, 4, 9, 10, 11, 20, 21, 30, 31, 32)}


def test_reference_of_a_hub_with_a_larger_hub(spark):
    """A hub that was compared with a larger one is known by its difference from that, one of none by itself."""
    rows = [(1, 1, []), (2, 1, [5]), (3, 1, [6]), (9, 1, [7, 8]), (9, 9, []), (20, 9, [4]), (40, 40, []), (41, 40, [3])]
    hubs = spark.createDataFrame([(a, b, 10, 10, 9, d) for a, b, d in rows], "a long, b long, size_a long, size_b long, common long, delta array<long>")
    refs = J._Join(None, None, None, 3, Fraction(9, 10)).reference(hubs)
    assert {(r["id"], r["ref"], len(r["delta"])) for r in refs.collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 1), (9, 1, 2), (20, 9, 1), (40, 40, 0), (41, 40, 1)}
