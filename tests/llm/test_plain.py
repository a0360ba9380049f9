"""The operators' plain parts against brute force, without Spark."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kindred.llm import classifier, decontaminate, packing, rans, simhash, sitetree, suffixes, tokencounts, tokens, warc
from kindred.llm.tokens import Encoder, vocabulary

ODD = [
    "", " ", "a  b", "  x", "x  ", "x \n y", " \n x", "it's don't I'LL we've", "ﬁ é é ΑΣ Σ", "a\tb \t c", "<|endoftext|> x",
    "日本語 テキスト", "½ x² 3", "a b   c", "\x1c x \x1d\x85", "'s 't", "x\n\n\ny \n\n z", "!!  ?? 12 345", "Über STRASSE ß", "a" * 500,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_words_give_the_librarys_ids(name):
    e, r = Encoder(vocabulary(name)), random.Random(1)
    texts = ODD + ["".join(r.choice("ab é.,\n 1'!ß") for _ in range(60)) for _ in range(400)]
    want = [e.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for end in (None, 2, 2):
        ids, at = e.encode_batch(pa.array([*(t.encode() for t in texts), None], pa.binary()), end)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [w + [end] * (end is not None) for w in [*want, []]]
    assert [np.frombuffer(e.encode(t), "<u4").tolist() for t in texts] == want
    assert e.encode_batch(pa.array([b"a\xff b"], pa.binary()))[0].tolist() == e.tok.encode("a\ufffd b", add_special_tokens=False).ids
    assert len(e.encode_batch(pa.array([], pa.binary()), 2)[0]) == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_special_tokens_are_as_in_a_fresh_tokenizer(name):
    from tokenizers import Tokenizer

    e, fresh, r = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name)), random.Random(3)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", " ", "\n", "word", "It's", "é", "<", "|>"]
    texts = [*parts, "a <|endoftext|> b", "<|endoftext|><|endoftext|>", *("".join(r.choices(parts, k=8)) for _ in range(300)), *ODD]
    ids, at = e.encode_batch(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert fresh.token_to_id("<|endoftext|>") in ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_what_is_remembered_is_bounded_in_bytes(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 20_000)
    e, r = Encoder(vocabulary(name)), random.Random(12)
    for _ in range(60):  # texts without blanks, each a piece of its own
        text = "".join(r.choices("abcdefgh", k=3000))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tok.encode(text, add_special_tokens=False).ids
        assert e.known.nbytes < 30_000 and e.flat.nbytes < 80_000


def test_plan_equals_best_fit_decreasing_one_by_one():
    r = random.Random(2)
    for _ in range(60):
        cap = r.choice([7, 20, 64])
        counts = Counter(r.randint(1, cap) for _ in range(r.randint(0, 120)))
        free: list[int] = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                if min(fits) - n:
                    free.append(min(fits) - n)
            else:
                free.append(cap - n)
        rows = sorted(packing.plan(dict(counts), cap))
        used: dict[int, list] = {}
        for n, c in counts.items():
            own = [x for x in rows if x[0] == n]
            for k in range(c):
                _, first, per, seq, off = [x for x in own if x[1] <= k][-1]
                used.setdefault(seq + (k - first) // per, []).append((off + (k - first) % per * n, n))
        for parts in used.values():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at <= cap
        left = sorted(cap - sum(n for _, n in p) for p in used.values())
        assert [x for x in left if x] == sorted(x for x in free if x)


def test_rans_round_trip_and_damage(tmp_path):
    r = np.random.default_rng(3)
    for n, top in ((1, 1), (63, 2), (5000, 300), (700_000, 50_257)):
        ids = np.minimum(r.zipf(1.3, n), top - 1 or 1) % top
        counts = np.bincount(ids, minlength=top)
        path = tmp_path / f"{n}.rans"
        with open(path, "wb") as f:
            w = rans.Writer(f, rans.Tables(counts), counts)
            cuts = [0, *sorted(r.integers(0, n + 1, 5).tolist()), n]
            for k, (i, j) in enumerate(zip(cuts, cuts[1:])):
                w.append(None if k == 2 else k, ids[i:j])
            w.close()
        with open(path, "rb") as f:
            got = list(rans.Reader(f).documents())
        assert [g[0] for g in got] == [None if k == 2 else k for k in range(6)]
        assert (np.concatenate([g[2] for g in got]) == ids).all() and [g[1] for g in got] == cuts[:-1]
        for step in (1, 2, 3):  # runs of blocks, read apart, give the same documents
            with open(path, "rb") as f:
                reader = rans.Reader(f)
                apart = [d for k in range(0, max(1, len(reader.blocks)), step) for d in reader.documents(k, k + step)]
            assert [(a, b, c.tolist()) for a, b, c in apart] == [(a, b, c.tolist()) for a, b, c in got]
    data = bytearray(path.read_bytes())
    data[len(data) // 2] ^= 1
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(rans.Reader(f).documents())


def test_simhash_and_forest():
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n ") == 0
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)
    w = [b"w%d" % (i % 37) for i in range(300)]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(298)]
    assert simhash.fingerprint(b"\t".join(w)) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 298)
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(5)]
    fps = sorted({b ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 3))) for b in base for _ in range(60)})
    edges = simhash._forest(np.array(fps, np.uint64), np.empty(0, np.uint64), 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    group = {f: f for f in fps}
    find = lambda x: x if group[x] == x else find(group[x])
    for a, b in edges:
        assert find(a) != find(b)  # a forest: no pair too many
        group[find(a)] = find(b)
    assert all(find(a) == find(b) for a in fps for b in fps if (a ^ b).bit_count() <= 3)
    filed, arrived = set(fps[::7]), set(fps) - set(fps[::7])
    edges = simhash._forest(np.array(sorted(filed), np.uint64), np.array(sorted(arrived), np.uint64), 3)
    group = {f: f for f in fps}
    for a, b in edges:
        assert (a ^ b).bit_count() <= 3 and (a in filed or b in filed) and find(a) != find(b)
        group[find(a)] = find(b)
    assert all(find(a) == find(b) for a in filed for b in fps if (a ^ b).bit_count() <= 3)


def test_multi_index_selects_and_loses_nothing():
    r = random.Random(5)
    vocab = [f"w{i}".encode() for i in range(3000)]
    for size, count, share in ((20, 2000, 0.02), (34, 2000, 0.05), (60, 300, 1.0), (200, 50, 1.0)):
        items = [r.choices(vocab, k=size) for _ in range(count)]
        counts = [decontaminate.shingles(w) for w in items]
        index = decontaminate.MultiIndex(counts)
        met, near, bands = 0, 0, Counter()
        for k in r.sample(range(count), 40):
            for edits in range(1 + size // 10):
                w = list(items[k])
                at = r.randrange(size - edits + 1)
                for e in range(edits):  # together or spread
                    w[at + e if edits % 2 else r.randrange(size)] = r.choice(vocab)
                s = decontaminate.shingles(w)
                sums = decontaminate.sums(s)
                met, near = met + len(index.met(sums)), near + 1
                found = set(index.near(sums))
                sim = decontaminate.similarity(s, counts[k])
                bands[round(sim, 1)] += 1
                assert k in found or sim < 0.8
        assert {0.8, 0.9, 1.0} <= set(bands)  # every band was tried
        assert met <= share * near * count + near


def test_decontamination_equals_all_windows():
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(r.choices(vocab, k=r.choice([1, 2, 3, 4, 5, 12, 30, 50])))) for k in range(40)]
    docs = []
    for _ in range(60):
        w = r.choices(vocab, k=r.randint(0, 150))
        for k in r.sample(range(40), 2):
            part = items[k][1].split()
            for _ in range(r.randint(0, 2)):
                part[r.randrange(len(part))] = r.choice(vocab)
            at = r.randint(0, len(w))
            w[at:at] = part
        docs.append(", ".join(w).upper())
    docs += [items[0][1], "", items[3][1] + "!"]
    bench, n = decontaminate.Benchmark([(k, t.encode()) for k, t in items]), 0
    for d in docs:
        got = {k: s for k, _, _, s in bench.matches(d.encode())}
        w = decontaminate.words(d.encode())
        for k, t in items:
            iw = decontaminate.words(t.encode())
            if len(iw) < 5:
                want = 1.0 if any(w[i : i + len(iw)] == iw for i in range(len(w) - len(iw) + 1)) else 0.0
            else:
                want = max(decontaminate.similarity(decontaminate.shingles(w[i : i + len(iw)]), decontaminate.shingles(iw)) for i in range(max(1, len(w) - len(iw) + 1)))
            assert got.get(k) == (want if want >= 0.8 else None)
            n += want >= 0.8
    assert n > 20 and bench.matches(None) == []


def test_warc_round_trip():
    pages = [(str(i), None if i == 3 else f"http://a/{i}\n", f"<html>{'shared words ' * 20}{i}</html>".encode() if i % 5 else b"") for i in range(60)]
    import hashlib

    recs = [warc.record(k, u, p, hashlib.sha256(p).hexdigest(), "1" if k == "7" else None) for k, u, p in pages] + [warc.record(None, None, b"x\r\n\r\ny", hashlib.sha256(b"x\r\n\r\ny").hexdigest(), None)]
    for part in (recs, recs[:1], []):
        assert list(warc.records(warc.archive(part))) == part
    data = warc.archive(recs)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and len(data) < sum(map(len, recs)) / 3
    got = [warc.parse(r) for r in recs]
    assert [g["payload"] for g in got[:60]] == [None if k == "7" else p for k, _, p in pages]
    assert got[7]["refers_to"] == "1" and got[7]["payload_bytes"] == len(pages[7][2]) and got[3]["url"] is None
    assert got[60]["page_id"] is None and got[60]["payload"] == b"x\r\n\r\ny" and got[1]["url"] == "http://a/1%0A"


def test_unigram_counts_equal_the_library():
    from tokenizers import Tokenizer, models

    model, _ = tokencounts._model(vocabulary("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *model.scores.items()], unk_id=0, byte_fallback=False))
    r = random.Random(7)
    words = sorted({tokencounts.MARK + "".join(r.choice("theingaornßéx日") for _ in range(r.randint(1, 14))) for _ in range(600)})
    for w, n in model.counts(words):
        e = lib.encode(w)
        assert n == sum(1 if i else len(w[a:b].encode()) for i, (a, b) in zip(e.ids, e.offsets)), w


def test_main_text():
    page = (
        "<html><head><title>t</title><script>var a='</p><article>no</article>';</script></head><body><header>top</header><nav><a>menu</a></nav>"
        "<div class='ad'>buy</div><article><h1>T &amp;amp; é &#33;</h1><p><b>one<br>two<p>three\n\n four</p><form>f</form><div class='comments'>c</div><aside>s</aside></article><footer>end</footer></body>"
    )
    assert sitetree.main_text(sitetree.parse(page)) == "T &amp; é !\none two\nthree four"
    assert sitetree.main_text(sitetree.parse("")) == ""
    body = "<body><div id=top>same</div><div><p>own</p></div></body>"
    assert sitetree.main_text(sitetree.parse(body)) == "same\nown"
    tree = sitetree.parse("<body><div class=x>same</div><div><p>own</p><p>text</p></div></body>")
    low = {tree.children[0].children[0].path}
    assert sitetree.main_text(tree, low) == "own\ntext"
    deep = "<div>" * 5000 + "x"
    assert sitetree.main_text(sitetree.parse(deep)) == "x"
    assert len({r[0] for r in sitetree.styles(sitetree.parse(deep))}) == sitetree.DEPTH
    assert sum(len(r[3] or ()) for r in sitetree.styles(sitetree.parse(deep))) < 64 * 65
    assert sitetree.main_text(sitetree.parse("<article>a < b <p")) == "a < b"


def test_anchors_depend_on_the_string_alone():
    r = random.Random(8)
    s = bytes(r.randrange(97, 100) for _ in range(200))
    seen = set()
    for _ in range(20):
        t = bytes(r.randrange(97, 100) for _ in range(r.randint(0, 90)))
        data = np.frombuffer(t + s + t[::-1], np.uint8)
        _, a, lo, hi, h = suffixes.anchors(data, np.array([0]), np.array([len(data)]))
        k = np.flatnonzero((lo <= len(t)) & (hi >= len(t)))
        assert len(k) == 1
        seen.add((int(a[k[0]]) - len(t), int(h[k[0]])))
    assert len(seen) == 1


def test_merge_gives_order_and_common_prefixes():
    r = random.Random(9)
    word = lambda: bytes(r.choice(b"ab") for _ in range(r.randint(1, 30)))
    runs = [sorted((word(), b"", 0, i, j) for j in range(r.randint(0, 40))) for i in range(7)]
    out = list(suffixes.merge([suffixes.decode(suffixes.front_code(x)) for x in runs]))
    keys = [s[0] for _, s in out]
    assert keys == sorted(s[0] for x in runs for s in x)
    assert [n for n, _ in out] == [suffixes.shared(a, b) for a, b in zip([b"", *keys], keys)]
    assert list(suffixes.merge([])) == []


def test_many_and_few_suffixes_agree():
    r = random.Random(10)
    group = sorted({(b"k" * 8 + b"g" * 64 + bytes(r.choice(b"ab") for _ in range(5)) * 27, bytes(r.choice(b"ab") for _ in range(3)) * r.randint(0, 20), 0, i, 1000) for i in range(60)})
    right = [0] + [suffixes.shared(a[0], b[0]) - 8 for a, b in zip(group, group[1:])]
    cover = lambda spans: {(u, s) for u, a, b in spans for s in range(a, b + 1)}
    many = cover(suffixes.repeats(group, right))

    def brute(group: list) -> set:
        want = set()
        for x in group:
            for d in range(len(x[1]) + 1):
                string = x[1][len(x[1]) - d :] + x[0][8 : 8 + 200 - d]
                if len(string) == 200 and any(y is not x and d <= len(y[1]) and y[1][len(y[1]) - d :] + y[0][8 : 8 + 200 - d] == string for y in group):
                    want.add((x[3], 1000 - d))
        return want

    assert many == brute(group)
    for at in range(0, len(group), 12):  # sixteen and fewer go another way
        few = group[at : at + 12]
        shared = [0] + [suffixes.shared(a[0], b[0]) - 8 for a, b in zip(few, few[1:])]
        assert cover(suffixes.repeats(few, shared)) == brute(few)


def test_rule_ensemble():
    r = np.random.default_rng(11)
    x = r.random((3000, len(classifier.FEATURES)))
    y = ((x[:, 0] > 0.7) | (x[:, 1] < 0.2)).astype(float)
    m = classifier.fit(x[:2000], y[:2000])
    assert ((m.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97 and 0 < len(m.rules) < 200
    one = classifier.fit(x[:10], np.ones(10))
    assert not one.rules and 0.5 < one.predict(x[:1])[0] < 1
    assert classifier.fit(x[:0], y[:0]).predict(x[:1])[0] == 0.5


def test_crc_of_ids_is_little_endian():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")
