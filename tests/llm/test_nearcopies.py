"""The pipeline's near-dedup stage against brute-force similarities of 5-word shingles."""

import random

import numpy as np

import corpus_pipeline
from kindred.llm import nearcopies, simhash
from kindred.llm.common import components

WORDS = [f"wort{i}" for i in range(900)]


def texts() -> list[tuple]:
    """Copies with more and more changed words, around and below the similarity, in chains and in one large group."""
    r = random.Random(5)
    rows = []
    for k in range(1, 41):
        w = r.choices(WORDS, k=r.randint(6, 200))
        rows.append((1000 * k + 900, " ".join(w)))
        for i in range(r.randint(1, 6)):
            w = w if r.random() < 0.5 else list(w)  # a chain, or copies of one text
            for _ in range(r.randint(0, 1 + len(w) // 50)):
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((1000 * k + i, " ".join(w)))
    base = r.choices(WORDS, k=150)
    for i in range(150):
        w = list(base)
        w[r.randrange(150)] = f"x{i}"
        w[r.randrange(150)] = f"y{i}"
        rows.append((90000 + i, " ".join(w)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two three four five"), (None, rows[0][1]), (None, None), (rows[0][0], rows[0][1]), (7, "ein Text ퟿ é " * 50)]
    r.shuffle(rows)
    return rows


def shingle_set(t: str | None) -> set[tuple]:
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows: list[tuple]) -> dict:
    """Each id's group by all pairs."""
    named = [(i, shingle_set(t)) for i, t in rows if i is not None]
    low = {i: i for i, _ in named}
    links = [(i, j) for i, a in named for j, b in named if i < j and (a == b or 5 * len(a & b) >= 4 * len(a | b))]
    while any(low[i] != low[j] for i, j in links):
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


def test_near_copies_equal_brute_force(spark):
    rows = texts()
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for kw in ({}, {"block": 40}, {"size": 3000}):  # the latter two split the large group
        got = nearcopies.near_copies(docs, **kw).collect()
        assert {r["id"]: r["component"] for r in got} == want and len(got) == sum(i is not None for i, _ in rows)
    assert nearcopies.near_copies(docs.limit(0)).count() == 0


def test_pipeline_stage_drops_near_copies(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    low = brute(rows)
    assert sorted(i for i in got if i is not None) == sorted(i for i, k in low.items() if i == k) and got.count(None) == 2


def test_band_keys_meet_as_often_as_expected():
    r = np.random.default_rng(1)
    met = 0
    for _ in range(300):
        s = r.integers(0, 1 << 63, 110, np.uint64)
        met += len(set(nearcopies.keys(s[:99])) & set(nearcopies.keys(s[11:])))  # similarity 88/110 = 0.8
    assert abs(met / 300 / nearcopies.BANDS - 0.8**nearcopies.ROWS) < 0.03


def test_wide_fingerprints_differ_and_meet_as_often_as_expected():
    r = np.random.default_rng(3)
    width, number = simhash.wide_plan(10_000)
    words = -(-(simhash.SKETCH + width * number) // 64)
    for common, own in ((400, 50), (12, 1)):  # similarity 400/500 and 12/14
        apart, met, n = [], [], 300
        for _ in range(n):
            s = r.integers(0, 1 << 63, common + 2 * own, np.uint64)
            a, b = (np.unpackbits(simhash.wide_fingerprint(x, words), bitorder="little") for x in (s[: common + own], s[own:]))
            apart.append(int((a != b)[: simhash.SKETCH].sum()))
            met.append(int((a == b)[simhash.SKETCH : simhash.SKETCH + width * number].reshape(number, width).all(axis=1).sum()))
        share = np.mean(apart) / simhash.SKETCH
        assert 0.09 < share < simhash.FLIP + 0.005 and max(apart) <= simhash.WIDE_RADIUS and min(met) > 0
        assert abs(np.mean(met) / number - (1 - share) ** width) < 0.03
    unlike = [simhash.wide_fingerprint(r.integers(0, 1 << 63, 300, np.uint64), 2).view(np.uint64) for _ in range(300)]
    apart = [int(np.bitwise_count(a ^ b).sum()) for i, a in enumerate(unlike) for b in unlike[:i]]
    assert abs(np.mean(apart) - 64) < 1.5 and min(apart) > simhash.WIDE_RADIUS - 3


def test_segments_widen_with_the_corpus():
    for n in (0, 1, 10**5, 10**7, 10**10):
        width, number = simhash.wide_plan(n)
        assert n / 2**width <= simhash.CROWD and (1 - (1 - simhash.FLIP) ** width) ** number <= simhash.LOSS * 1.1


def test_pipeline_stage_finds_candidates_by_simhash(spark, monkeypatch):
    called = []
    links = nearcopies.wide_links
    monkeypatch.setattr(nearcopies, "wide_links", lambda *a, **kw: called.append(a) or links(*a, **kw))
    docs = spark.createDataFrame([(i, " ".join(WORDS[i // 2 * 100 : i // 2 * 100 + 90 + i % 2]), "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2, 4] and called


def test_simhash_and_minhash_candidates_give_the_same_groups(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["id"]: r["component"] for r in nearcopies.near_copies(docs, find=nearcopies.by_minhash).collect()} == brute(rows)


def test_wide_links_of_a_hot_value_are_the_same_in_blocks(spark):
    r = random.Random(2)
    base = r.choices(WORDS, k=150)
    sets = [nearcopies.shingles(" ".join([*base[: i % 40], f"x{i}", *base[i % 40 :]]).encode()) for i in range(700)]
    width, number = simhash.wide_plan(700)
    words = -(-(simhash.SKETCH + width * number) // 64)
    fps = spark.createDataFrame([(nearcopies.digest(s), bytearray(simhash.wide_fingerprint(s, words).tobytes())) for s in sets], "fp long, bits binary").repartition(3)
    for block in (simhash.BLOCK, 100):
        links = simhash.wide_links(fps, width, number, block=block)
        assert {x["root"] for x in components(links).collect()} == {min(nearcopies.digest(s) for s in sets)}


def joined(links: list[tuple]) -> dict:
    """The least name that links reach, of each name."""
    low = {x: x for link in links for x in link}
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return low


def test_links_of_a_large_group_do_not_grow_with_segments_or_blocks(spark):
    """Texts of one template, alike by 128 bits and less alike than 0.8: they meet under many values of all segments."""
    r = random.Random(6)
    base = r.choices(WORDS, k=120)
    sets = [nearcopies.shingles(" ".join(f"x{i}y{j}" if r.random() < 0.05 else w for j, w in enumerate(base)).encode()) for i in range(1500)]
    width, number = simhash.wide_plan(1500)
    words = -(-(simhash.SKETCH + width * number) // 64)
    bits = [simhash.wide_fingerprint(s, words) for s in sets]
    fps = spark.createDataFrame([(nearcopies.digest(s), bytearray(b.tobytes())) for s, b in zip(sets, bits)], "fp long, bits binary").repartition(3)
    flat = np.unpackbits(np.stack(bits)[:, simhash.SKETCH // 8 :], axis=1, count=width * number, bitorder="little").reshape(1500, number, width) @ (1 << np.arange(width))
    sketch = np.stack([b[: simhash.SKETCH // 8].view(np.uint64) for b in bits])
    names = [nearcopies.digest(s) for s in sets]
    pairs = []
    for i in range(1500):
        near = (np.bitwise_count(sketch[i] ^ sketch[:i]).sum(axis=1) <= simhash.WIDE_RADIUS) & (flat[i] == flat[:i]).any(axis=1)
        pairs += [(names[i], names[j]) for j in np.flatnonzero(near)]
    assert len(pairs) > 40 * 1500
    want = joined(pairs)
    for block in (simhash.BLOCK, 60):
        links = [tuple(x) for x in simhash.wide_links(fps, width, number, block=block).distinct().collect()]
        early = [tuple(x) for x in simhash.wide_links(fps, width, simhash.EARLY, block=block).distinct().collect()]
        assert joined(links) == want and len(links) < 1.2 * 1500 and len(early) < 1500


def test_blocks_tell_only_links_between_their_groups():
    r = np.random.default_rng(8)
    bases = [r.integers(0, 1 << 63, 100, np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([bases[i % 4][: 100 - i % 7], r.integers(0, 1 << 63, i % 5, np.uint64)])) for i in range(120)]
    names, side = list(range(120)), [1 + i % 3 % 2 for i in range(120)]
    told = nearcopies.across(names, sets, side)
    own = [link for k in (1, 2) for link in nearcopies.forest([i for i in names if side[i] == k], [sets[i] for i in names if side[i] == k])]
    assert len(told) == 4 and all(side[a] != side[b] and nearcopies.similar(sets[a], sets[b]) for a, b in told)
    assert joined(own + told) == joined([(i, j) for i in names for j in names[:i] if nearcopies.similar(sets[i], sets[j])])
    assert nearcopies.across(names[:3], sets[:3], [1, 1, 1]) == []
    sketch = np.stack([simhash.wide_fingerprint(s, 2).view(np.uint64) for s in sets])
    name, sides = np.array(names), np.array(side)
    parts = [simhash._wide_forest(name[m], sketch[m], sides[m] * 0, 25) for m in (sides == 1, sides == 2)]
    whole = simhash._wide_forest(name, sketch, sides * 0, 25)
    cross = simhash._wide_forest(name, sketch, sides, 25)
    assert joined([*parts[0], *parts[1], *cross]) == joined(whole) and len(cross) < 10
    assert simhash._wide_forest(name // 4 * 0, sketch, sides, 25) == []
