"""Each operator on a small table with nulls, empty and long texts, repeated rows and clashing columns, and on an empty one."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from kindred.llm import classifier, decontaminate, nearcopies, packing, rules, simhash, sitetree, suffixes, tokencounts, tokenfiles, warc
from kindred.llm.common import components, scratch
from kindred.llm.tokens import Encoder, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score double, key string, spans int, kept string, n_words string, ids string, uid string"
WORDS = [f"wort{i}" for i in range(900)]


def texts() -> list[tuple]:
    r = random.Random(1)
    say = lambda n: " ".join(r.choices(WORDS, k=n)) + "."
    passage, long = say(60), say(3000)
    rows = [(i, say(r.randint(1, 120)), "en") for i in range(40)]
    rows += [(50, passage, "en"), (51, say(30) + "\n" + passage + " x", "de"), (52, "é" + passage + say(5), None), (53, passage[5:], "en")]
    rows += [(60, long, "en"), (61, long, "en"), (62, long[:-9] + "other", "en"), (63, long + " " + long, "fr")]
    rows += [(70, None, None), (71, "", "en"), (72, " \n\t", "en"), (None, "no id " + say(20), "en"), (None, None, "en"), (73, "Ünï ü " * 50, "en"), (60, long, "en"), (74, "a" * 5000, "en")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, "s", len(t or ""), 7, "fp", 0.5, "k", 1, "x", "y", "z", None) for i, t, lang in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    r = random.Random(2)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100, 100), (None, 3)] + [(200 + i, 201 + i) for i in range(30)]
    got = dict(components(spark.createDataFrame(e, "a long, b long")).collect())
    group = {x: x for p in e[:40] + e[42:] for x in p}
    for _ in range(99):
        for a, b in e[:40] + e[42:]:
            group[a] = group[b] = min(group[a], group[b])
    assert got == {k: v for k, v in group.items() if any(k in p and p[0] != p[1] for p in e)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _sequences(counts: Counter):
    """(pieces in the row, first sequence, per sequence) of the plan's rows."""
    rows = sorted(packing.plan(dict(counts), 256))
    for x, y in zip(rows, [*rows[1:], (None,)]):
        yield (y[1] if y[0] == x[0] else counts[x[0]]) - x[1], x[3], x[2]


def test_packing(docs, none, monkeypatch):
    path = vocabulary("word_bpe_49k.json")
    e = Encoder(path)
    got = packing.pack(docs, path, capacity=256).collect()
    monkeypatch.setattr(packing, "TABLE", 1)  # the way for tables too large to broadcast
    assert Counter(packing.pack(docs, path, capacity=256).select("sequence", "offset", "length").collect()) == Counter((r["sequence"], r["offset"], r["length"]) for r in got)
    want = Counter()
    for i, t, _ in texts():
        ids = np.frombuffer(e.encode(t or ""), "<u4").tolist() + [1]
        want.update((i, k // 256, k, tuple(ids[k : k + 256])) for k in range(0, len(ids), 256))
    assert Counter((r["id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    used: dict[int, list] = {}
    for r in got:
        used.setdefault(r["sequence"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        ends = [0]
        for off, n in sorted(parts):
            assert off == ends[-1]
            ends.append(off + n)
        assert ends[-1] <= 256
    assert len(used) == 1 + max(first + (n - 1) // per for n, first, per in _sequences(Counter(r["length"] for r in got)))
    assert packing.pack(none, path).count() == 0


def test_simhash(docs, none):
    rows = texts()
    fp = [simhash.fingerprint(t.encode() if t else None) for _, t, _ in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a in group:
            for b in range(len(rows)):
                if (fp[a] ^ fp[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    low = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in group}
    want = Counter((rows[k][0], fp[k], low[group[k]]) for k in range(len(rows)))
    got = simhash.near_duplicates(docs)
    assert Counter((r["id"], r["fp"] % (1 << 64), r["component"]) for r in got.collect()) == want
    d = simhash.deduplicated(docs)
    assert d.columns == docs.columns
    keep = Counter(r["doc_id"] for r in d.collect())
    assert keep == Counter({i for i, _, c in want if i == c and i is not None}) + Counter({None: 2})
    assert simhash.near_duplicates(none).count() == 0 == simhash.deduplicated(none).count()


@pytest.mark.parametrize("dedup", [simhash.deduplicated, nearcopies.deduplicated])
def test_dedup_decides_by_row(spark, dedup):
    r = random.Random(5)
    a, b, c = (" ".join(r.choices(WORDS, k=80)) for _ in range(3))
    rows = [(3, a, "x"), (5, a, "y"), (5, b, "y"), (5, b, "z"), (5, b, "a"), (6, b, "b"), (7, c, "c"), (7, a, "d"), (None, a, "e"), (None, None, "f"), (8, None, "g"), (8, "", "h"), (9, " ", "i")]
    t = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, _n string, digest int, row int, n int").repartition(3)
    got = dedup(t)
    assert got.columns == t.columns
    left = Counter((x["doc_id"], x["text"], x["_n"]) for x in got.collect())
    assert left - Counter(rows[10:12]) == Counter([rows[0], rows[4], rows[6], rows[8], rows[9]])
    assert (left & Counter(rows[10:12])).total() == 1  # one group, one id, two texts
    assert dedup(t.limit(0)).count() == 0


def test_simhash_splits_hot_segments(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    fps = sorted({base ^ sum(1 << r.randrange(34, 64) for _ in range(r.randint(0, 3))) for _ in range(300)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for block in (20, 4096):
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.link(df, block=block).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        group = {f: f for f in fps}
        for _ in range(40):
            for a, b in links:
                group[a] = group[b] = min(group[a], group[b])
        assert all(group[a] == group[b] for a in fps for b in fps if (a ^ b).bit_count() <= 3)


def test_neighbours_of_hot_segments_are_split(spark):
    """One low half for many fingerprints, and one fingerprint filed a bit below it, where they all arrive."""
    r = random.Random(4)
    low = r.getrandbits(32) | 5
    fps = sorted({r.getrandbits(30) << 32 | low for _ in range(400)})
    near = [fps[7] ^ 1, fps[90] ^ 4 ^ 1 << 40 ^ 1 << 41]
    df = spark.createDataFrame([(f,) for f in fps + near], "fp long")
    hot = {x["key"]: x["n"] for x in simhash.hot_keys(df, 64).collect()}
    assert hot[low] == -(-len(fps) // 64) and hot[low ^ 1] == hot[low] and {low ^ 1 << j for j in range(32) if low >> j & 1} < set(hot)
    for broadcast in (0, 1000):
        links = simhash.link(df, block=64, broadcast=broadcast).collect()
        got = {frozenset(x) for x in links}
        assert got == {frozenset((a, b)) for a in fps + near for b in fps + near if a < b and (a ^ b).bit_count() <= 3}


def brute_repeats(rows: list[bytes]) -> list[list[tuple[int, int]]]:
    seen = Counter(t[i : i + 200] for t in rows for i in range(len(t) - 199))
    out = []
    for t in rows:
        spans: list[list[int]] = []
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 200
                else:
                    spans.append([i, i + 200])
        out.append([tuple(s) for s in spans])
    return out


def test_suffix_dedup(docs, none, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t, _ in texts()]
    want = Counter()
    for (i, t), spans in zip(rows, brute_repeats([t for _, t in rows])):
        edges = [0, *(e for s in spans for e in s), len(t)]
        want[i, len(t), b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])), tuple(spans)] += 1
    got = suffixes.suffix_dedup(docs, keep=("lang",))
    assert Counter((r["id"], r["n_bytes"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in got.collect()) == want
    split = suffixes.suffix_dedup(docs, keep=("lang",), hot=1)  # every repeated anchor is split
    assert Counter((r["id"], r["n_bytes"], bytes(r["kept"]), tuple(map(tuple, r["spans"]))) for r in split.collect()) == want
    clash = suffixes.suffix_dedup(docs, keep=("key", "fp", "uid"))
    assert clash.columns == ["id", "key", "fp", "uid", "n_bytes", "kept", "spans"] and clash.where("key = 'k' and fp = 'fp'").count() == docs.count()
    assert suffixes.suffix_dedup(none).count() == 0


def test_decontamination(spark, docs, none, monkeypatch):
    t = dict((i, t) for i, t, _ in texts())
    items = spark.createDataFrame([(1, t[50]), (2, None), (3, ""), (4, t[50]), (5, "Ünï ü")], "item_id long, text string")
    got = {(r["id"], r["item"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert {(i, k) for i in (50, 51, 52, 53) for k in (1, 4)} | {(73, 5)} == got
    left = decontaminate.decontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 5
    monkeypatch.setattr(decontaminate, "ITEMS", 100)  # several blocks, one after another
    assert {(r["id"], r["item"]) for r in decontaminate.contaminated(docs, items).collect()} == got
    assert Counter(r["doc_id"] for r in decontaminate.decontaminated(docs, items).collect()) == Counter(r["doc_id"] for r in left.collect())
    assert decontaminate.decontaminated(none, items).count() == 0 and decontaminate.decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(none, items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()


def test_quality_rules(spark, docs, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (60, None, 0)], "doc_id long, quality int, toxic int")
    got = Counter()
    for r in rules.quality_rules(docs, labels).collect():
        got[r["id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]] += 1
        assert r["kept"] in (False, not r["base_failed"])
    want = Counter()
    for i, t, _ in texts():
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        c = Counter(zip(w, w[1:], w[2:]))
        rep = len({k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)})
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)] += 1
    assert got == want
    assert rules.quality_rules(none, labels).count() == 0
    assert rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_bound(spark):
    from math import comb

    from pyspark.sql import functions as F

    rows = [(n, k) for n in (1, 30, 400) for k in (0, 1, 7) if k < n]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", F.exp(rules.log_binomial_cdf(F.col("n"), F.col("k"), 0.05))).collect()
    for n, k, p in got:
        assert p == pytest.approx(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_classifier(spark, docs, none):
    junk = [(1000 + i, "#|# $ % " * (20 + i), "en") for i in range(60)] + [(2000 + i, " ".join(WORDS[i : i + 80]) + ".", "en") for i in range(60)]
    t = spark.createDataFrame([(i, x, g) for i, x, g in texts() + junk], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i >= 2000), 0) for i, _, _ in junk] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = classifier.train(t, labels)
    got = classifier.score(t, model).collect()
    assert len(got) == t.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all((r["score"] >= 0.7) == (r["id"] >= 2000) for r in got if r["id"] and r["id"] >= 1000)
    import pandas as pd

    from kindred.llm.textstats import FEATURES, with_features

    f = with_features(t, "text", ("doc_id",)).toPandas()
    want = Counter((None if pd.isna(i) else int(i), round(float(p), 9)) for i, p in zip(f["doc_id"], model.predict(f[list(FEATURES)].to_numpy(float))))
    assert model.rules and Counter((r["id"], round(r["score"], 9)) for r in got) == want  # the compiled column against plain numpy
    plain = {r["doc_id"]: r for r in f.to_dict("records")}
    for i in (51, 73, 74, 1000, 2000):
        w = next(x for k, x, _ in texts() + junk if k == i).split()
        assert plain[i]["n_words"] == len(w) and abs(plain[i]["word_len"] - sum(map(len, w)) / len(w)) < 1e-9
        assert abs(plain[i]["distinct"] - len(set(w)) / len(w)) < 1e-9
    assert classifier.accepted(docs, model).columns == docs.columns
    assert classifier.accepted(none, model).count() == 0
    assert classifier.score(none, model).count() == 0
    assert classifier.train(t, labels.limit(0)).rules == ()


def test_token_files(spark, docs, none):
    path = vocabulary("byte_bpe_50k.json")
    e = Encoder(path)
    files = tokenfiles.write_tokens(docs, scratch(spark, "tokens"), path)
    got = sorted(((r["start"], r["id"], r["n_tokens"], bytes(r["ids"])) for r in tokenfiles.read_tokens(files).collect()))
    rows = [(i, e.encode(t or "") + (2).to_bytes(4, "little")) for i, t, _ in texts()]
    assert Counter((g[1], g[3]) for g in got) == Counter(rows)
    ids = [-1 if g[1] is None else g[1] for g in got]
    assert ids == sorted(ids) and [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert tokenfiles.read_tokens(tokenfiles.write_tokens(none, scratch(spark, "tokens"), path)).count() == 0


def test_token_counts(docs, none):
    path = vocabulary("piece_bpe_32k.model")
    model, memo = tokencounts._model(path)
    one = lambda w: dict(model.counts([tokencounts.MARK + w])).popitem()[1]  # noqa: E731  a word alone, nothing shared or remembered
    got = Counter((r["id"], r["n_tokens"]) for r in tokencounts.count_tokens(docs, path).collect())
    assert got == Counter((i, sum(map(one, (t or "").encode().decode().split()))) for i, t, _ in texts())
    assert tokencounts.count_tokens(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_warc(spark):
    body = "<html>" + "x" * 200
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" + "y" * i) for i in range(150)] + [(200, None, body), (190, "u", body), (None, "u", body), (190, "u", body), (201, "u", "short"), (202, "u", "short"), (203, "u", None), (None, "v", "z" * 300), (None, "v", "z" * 300)]
    pages = spark.createDataFrame([(*r, 1, "low") for r in rows], "page_id long, url string, html string, id int, low string").repartition(2)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_warc(warc.write_warc(pages, scratch(spark, "warc"), roll=3000)).collect())
    want = Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == body and i != 190
        want[None if i is None else str(i), len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", "190" if revisit else None] += 1
    assert got == want
    assert warc.read_warc(warc.write_warc(pages.limit(0), scratch(spark, "warc"))).count() == 0


def test_site_tree(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div id=t>Site name</div><section><p>own {i}</p></section></body>") for i in range(12)]
    rows += [(20, None, "<article>a</article>"), (21, "x", None), (None, "http://h.example/9", "<article>b<nav>n</nav></article>"), (22, "http://one.example/", rows[0][2])]
    pages = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, id int, paths string")
    got = {r["id"]: r["text"] for r in sitetree.extract(pages).collect()}
    assert got == {**{i: f"own {i}" for i in range(12)}, 20: "a", 21: "", None: "b", 22: "Site name\nown 0"}
    forced = sitetree.extract(pages, broadcast=-1)  # as when copies and low nodes are too many to broadcast
    assert {r["id"]: r["text"] for r in forced.collect()} == got
    assert sitetree.extract(pages.limit(0)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path_factory):
    """Every stage against a plain restatement on its own input."""
    d = str(tmp_path_factory.mktemp("sf"))
    rows = texts() + [(3000 + i, "#|# $ % " * (20 + i), "en") for i in range(40)] + [(4000 + i, " ".join(random.Random(i).choices(WORDS, k=80)) + ".", "en") for i in range(60)]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 4000), 0) for i, _, _ in rows if i and i >= 3000], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, rows[-1][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], d).write.parquet(f"{d}/{name}")
        seen.append(spark.read.parquet(f"{d}/{name}"))
    raw, good, near, cut, clean, packed = ([r.asDict() for r in s.collect()] for s in seen)
    assert all(s.columns == list(corpus_pipeline.COLUMNS) for s in seen[:5])
    assert {r["doc_id"] for r in good} >= set(range(4000, 4060)) and not {r["doc_id"] for r in good} & set(range(3000, 3040))
    def shingles(r: dict) -> set:
        w = (r["text"] or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    named = [(r, shingles(r)) for r in good if r["doc_id"] is not None]
    low = [r["doc_id"] for r, _ in named]
    alike = [(i, j) for i, (_, a) in enumerate(named) for j, (_, b) in enumerate(named) if i < j and 5 * len(a & b) >= 4 * len(a | b)]
    for _ in range(6):
        for i, j in alike:
            low[i] = low[j] = min(low[i], low[j])
    assert Counter(r["doc_id"] for r in near) == Counter({r["doc_id"] for (r, _), x in zip(named, low) if x == r["doc_id"]}) + Counter(None for r in good if r["doc_id"] is None)
    assert {50, 60} <= {r["doc_id"] for r in near} and not {51, 52, 53, 61, 62} & {r["doc_id"] for r in near} - {51}
    bodies = [(r["text"] or "").encode() for r in near]
    want = Counter()
    for r, t, spans in zip(near, bodies, brute_repeats(bodies)):
        edges = [0, *(e for s in spans for e in s), len(t)]
        want[r["doc_id"], b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2])).decode("utf-8", "ignore")] += 1
    assert Counter((r["doc_id"], r["text"]) for r in cut) == want and all(len(r["text"]) == r["n_chars"] for r in cut)
    assert {r["doc_id"] for r in cut} - {r["doc_id"] for r in clean} == {rows[-1][0]}
    e = Encoder(vocabulary("word_bpe_49k.json"))
    whole: dict = {}
    for r in sorted(packed, key=lambda r: r["piece"]):
        whole[r["doc_id"], r["start"] if r["doc_id"] is None else 0] = whole.get((r["doc_id"], 0), b"") + r["ids"]
    by_id = Counter((i, zlib.crc32(ids)) for (i, _), ids in whole.items() if i is not None)
    assert by_id == Counter((r["doc_id"], zlib.crc32(e.encode(r["text"]) + (1).to_bytes(4, "little"))) for r in clean if r["doc_id"] is not None)
    assert spark.read.parquet(f"{d}/packing").count() == corpus_pipeline.run(spark, d).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("texts_")]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0, name
