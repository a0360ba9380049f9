"""Secret scan, fill-in-middle and filter audit against brute force, with nulls, empty, long and repeated texts."""

import hashlib
import random
import re
import string
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import filteraudit, fim, queries, secretscan
from kindred.llm.tokens import vocabulary

SCHEMA = "doc_id long, text string, lang string, id string, spans string, flags string, digest string, form string, part string, kept string, a string, e string"
PATH = vocabulary(secretscan.VOCABULARY)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, *["x"] * 9) for i, t, lang in rows], SCHEMA).repartition(3)


def query(spark, tmp_path, name, rows, labels=()):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return queries.QUERIES[name](spark, str(tmp_path)).collect()


# --- op11


def base_spans(text: str) -> list[tuple]:
    """The contract's base, character by character where a pattern could be read two ways."""
    out = []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for k, first, more, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set("0123456789abcdef"), 24)):
        at = 0
        while at < len(text):
            end = at + len(first)
            if text.startswith(first, at) and end < len(text) and text[end] in more:
                while end < len(text) and text[end] in more:
                    end += 1
                if end - at >= least:
                    out.append((at, k, end))
                at = end
            else:
                at += 1
    return sorted(out)


def secret_rows():
    r = random.Random(5)
    pick = lambda al, n: "".join(r.choices(al, k=n))
    b64 = string.ascii_letters + string.digits + "+/"
    alnum = string.ascii_letters + string.digits
    texts = [
        'Token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" é',
        "password:short PASSWD='longer1' api_key=abcdef apikey : \"x.y=z-1\" secret=" + "a" * 5,
        "token=secret=abcdef tokens: x token\n= abcdefgh toKen=abcdefgh",
        "AKIA" + pick(string.ascii_uppercase, 15) + " AKIA" + pick(string.ascii_uppercase, 16) + " xAKIAAKIA" + pick(string.digits, 14),
        "0" * 23 + "g" + "a" * 24 + "A" + "f" * 100,
        "ſecret=abcdefgh toKen=abcdefgh 😀 secret=abcdefgh",
        "see " + pick(b64, 43) + "= end",
        "key " + pick(alnum, 32),
        None,
        "",
        " \n",
        "a " * 40000 + "token=" + "Z9" * 20000,
        pick("tokenakiATOKEN=: 'abcdef0123456789AKI", 3000),
    ]
    return [(i, t, "en") for i, t in enumerate(texts)] + [(0, texts[0], "en"), (None, texts[6], None)]


def test_secrets_equal_brute_force(spark, tmp_path):
    rows = secret_rows()
    got = query(spark, tmp_path, "op11_secret_scan", rows)
    want = Counter()
    for i, t, _ in rows:
        f = base_spans(t or "")
        joined = ",".join(f"{secretscan.KINDS[k]}:{s}:{e}" for s, k, e in f)
        want[i, *(sum(k == x for _, k, _ in f) for x in range(3)), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    by_id = {r.doc_id: r for r in got}
    for i, t, _ in rows:  # base spans stay, the method's come in between, in order
        f = [x.split(":") for x in by_id[i].spans.split(",")] if by_id[i].spans else []
        keys = [(int(s), secretscan.KINDS.index(k)) for k, s, _ in f]
        assert keys == sorted(keys) and [(int(s), secretscan.KINDS.index(k), int(e)) for k, s, e in f if k != "random"] == base_spans(t or "")
    assert by_id[6].spans == "random:4:48" and by_id[7].spans == "random:4:36"
    empty = secretscan.secrets(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["id", "spans", "redacted"]


def test_random_strings_and_names():
    r = random.Random(6)
    found = lambda s: bool(secretscan.spans(f"so {s} is", PATH))
    alphabets = {"base64": string.ascii_letters + string.digits + "+/", "alnum": string.ascii_letters + string.digits, "base32": string.ascii_uppercase + "234567"}
    least = {"base64": 0.99, "alnum": 0.98, "base32": 0.85}
    for name, al in alphabets.items():
        for n in (20, 32, 64):
            assert sum(found("".join(r.choices(al, k=n))) for _ in range(300)) >= 300 * least[name], (name, n)
    names = [
        "getElementsByClassNameAndTag", "max_number_of_rows_per_batch", "node_modules/react-dom/index", "2024-11-28-12-30-59-000", "TOTAL_NUMBER_OF_ENTRIES_IN_TABLE",
        "123e4567-e89b-12d3-a456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "sha384-oqVuAfXRKap7fdgcCY5uykM6", "Donaudampfschifffahrtsgesellschaft",
        "==============================", "40404040404040404040404", "src/main/resources/application",
    ]
    assert [x for x in names if found(x)] == []
    assert secretscan.redacted("a token=abcdef b", secretscan.spans("a token=abcdef b", PATH)) == "a <assign> b"
    assert secretscan.redacted('x secret="AKIA' + "Q" * 16 + '" y', [("assign", 2, 30), ("access", 10, 30)]) == 'x <assign>" y'


# --- op12


def fim_plain(i, t):
    t = t or ""
    h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (i, n, "plain", None, None, sha(t), sha(t))
    p, m, s = t[:a], t[a:b], t[b:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (i, n, form, a, b - a, sha(out), sha(t))


def test_fill_in_middle_equals_brute_force(spark, tmp_path):
    r = random.Random(7)
    mixed = "aé<P>SM日本😀\n c\x7f߿ࠀ￿\x00"
    rows = [(i, "".join(r.choices(mixed if i % 3 else mixed.replace(">", ""), k=r.randrange(60))), "en") for i in range(300)]
    rows += [(400, None, None), (401, "", "en"), (None, "ñ" * 50, "en"), (402, "x<M>y", "en"), (403, "<<P<S<M", "en"), (5, rows[5][1], "en"), (404, "日é" * 200_000, "en"), (405, "z" * 500_000, "en")]
    got = query(spark, tmp_path, "op12_fill_in_middle", rows)
    assert Counter(map(tuple, got)) == Counter(fim_plain(i, t) for i, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
    raw = spark.sql("SELECT 1L AS doc_id, cast(X'61FF62' AS string) AS text")
    assert fim.fill_in_middle(raw).first().n == 3


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab<PSM>éß日ࠀ😀𝒳\n\x7f\x80"), max_size=40))
def test_ranks(text):
    data = text.encode()
    ranks = fim.Ranks(data)
    assert ranks.n == len(text) and [ranks.byte(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]
    assert ranks.marked == any(s in text for s in fim.SENTINELS)
    runs = 1 + sum(len(a.encode()) != len(b.encode()) for a, b in zip(text, text[1:]))
    assert len(ranks.bytes) <= runs + 1  # an event a change of width, none a character


# --- op13


def audit_plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    flags = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i}
        flags.append((lang or "", fails, i in good, i in toxic))
    for part in {f[0] for f in flags}:
        own = [f for f in flags if f[0] == part]
        steps = {}
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, x in enumerate(order):
                gone = [f for f in left if f[1][x]]
                stay = [f for f in left if not f[1][x]]
                redundant = sum(f[1][x] for f in own) - len(gone)
                unique = sum(f[1][x] and sum(f[1].values()) == 1 for f in own)
                steps["".join(order), k + 1] = (len(stay), len(gone), redundant, unique, sum(f[2] for f in gone), sum(f[3] for f in gone))
                shapley[x] += len(gone)
                left = stay
        out += [(part, o, k, *v, shapley[o[k - 1]]) for (o, k), v in steps.items()]
    return out


def test_audit_equals_brute_force(spark, tmp_path):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(150):
        n = r.choice([5, 120, 120, 300])
        t = " ".join(r.choices(words[: r.choice([60, 400])], k=n))
        t = t.upper() if r.random() < 0.2 else t
        rows.append((i, t + r.choice(["", "", " 5 %", "\n#"]), r.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[i % 3][1], "fr") for i in range(40)] + [(3, rows[3][1], "en"), (3, "other text", "en"), (None, rows[4][1], "en"), (None, "no id", None), (500, None, None), (501, "", "en"), (502, "A" * 20, "it")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in range(0, 220, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    got = query(spark, tmp_path, "op13_filter_audit", rows, labels)
    assert Counter(map(tuple, got)) == Counter(audit_plain(rows, labels))
    assert len(got) == 120 * 5 * 5
    none = filteraudit.filter_audit(frame(spark, rows).limit(0), spark.createDataFrame(labels[:3], "doc_id long, quality int, toxic int"))
    assert none.count() == 0
    with pytest.raises(ValueError):
        filteraudit.subset_counts(spark.range(1), "id", dict.fromkeys("ABCDEFGH"), {})


def test_packed_bits():
    r = np.random.default_rng(9)
    for n in (1, 7, 8, 9, 1000):
        flags, codes = r.integers(0, 1 << 5, n), r.integers(0, 4, n)
        parts, counts = filteraudit.packed(flags, codes, 3, 2)
        for p, c in zip(parts, counts):
            own = flags[codes == p]
            for s in range(8):
                free = own[(own & s) == 0]
                assert c[:, s].tolist() == [len(free), int((free >> 3 & 1).sum()), int((free >> 4 & 1).sum())]
