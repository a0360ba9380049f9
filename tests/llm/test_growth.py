"""What must not grow with the corpus: buckets, files, groups of one anchor, exchanged payloads, scopes of other threads."""

import random
import threading

import numpy as np
import pyarrow as pa
import pytest

from kindred.llm import suffixes, tokenfiles, warc
from kindred.llm.common import noted, scratch
from kindred.llm.tokens import Encoder, vocabulary


def test_buckets_rise_with_the_bytes():
    gb = 1 << 30
    assert [suffixes.buckets(s, 200, 100_000) for s in (0, gb, 1000 * gb, 10**6 * gb)] == [200, 200, 4000, 100_000]
    assert suffixes.buckets(gb, 5, 3) == 5


def test_anchors_held_at_once_do_not_change_what_repeats(spark, monkeypatch):
    r = random.Random(4)
    same = [bytes(r.choices(range(97, 123), k=900)) for _ in range(3)]
    texts = [bytes(r.choices(range(97, 123), k=500)) + same[i % 3] for i in range(40)]

    def repeated(batch) -> set:
        """(uid, h) that go on, by the query's rule."""
        rows = [row for b in suffixes._anchor_rows([batch]) for row in b.to_pylist()]
        total: dict = {}
        for x in rows:
            if not x["known"]:
                total[x["w"]] = total.get(x["w"], 0) + x["n"]
        return {(x["uid"], x["h"]) for x in rows if x["known"] or x["n"] == 1 and total[x["w"]] >= 2}, total

    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts, pa.binary())], names=["uid", "t"])
    want, counts = repeated(batch)
    monkeypatch.setattr(suffixes, "GROUP", 2000)
    monkeypatch.setattr(suffixes, "HELD", 30)
    assert (want, counts) == repeated(batch) and want


def test_contexts_of_a_hot_anchor_meet_only_where_they_are_equal(spark):
    r = random.Random(8)
    passage = "".join(r.choices("abcdefgh ", k=300))
    rows = [(i, "".join(r.choices("ijklmnop ", k=150)) + passage + "".join(r.choices("qrstuvw ", k=150))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    usual, split = ({x["id"]: (bytes(x["kept"]), x["spans"]) for x in suffixes.suffix_dedup(docs, hot=h).collect()} for h in (1 << 16, 100))
    assert usual == split and all(k == rows[i][1].replace(passage, "").encode() for i, (k, _) in split.items() if len(k) == 300)
    assert max(len(k) for k, _ in split.values()) <= 300


def test_spans_that_touch_are_one_and_lanes_stay_apart():
    lane = 1 << 48
    spans = [(7, 5, 5), (7, 4, 4), (2, 0, 9), (7, 6, 8), (7, 10, 10), (7, lane, lane), (2, 3, 4), (2, 10, 11), (8, 9, 9)]
    assert suffixes.coalesced(np.array(spans)).tolist() == [[2, 0, 11], [7, 4, 8], [7, 10, 10], [7, lane, lane], [8, 9, 9]]
    assert suffixes.coalesced(np.empty((0, 3), np.int64)).shape == (0, 3)


def test_strings_of_a_hot_anchor_make_no_row_each(spark):
    r = random.Random(9)
    line = "".join(r.choices("abcdefgh ", k=900))
    rows = [(i, "".join(r.choices("ijklmnop ", k=300)), line + "".join(r.choices("qrstuvw ", k=300))) for i in range(200)]
    docs = spark.createDataFrame([(i, a + b) for i, a, b in rows], "doc_id long, text string").coalesce(1)
    texts = docs.selectExpr("doc_id uid", "0 lane", "cast(text as binary) t")
    spans = [[(x["lo"], x["hi"]) for x in row["spans"]] for row in suffixes.repeated_starts(texts, hot=100).collect()]
    starts = [{p for lo, hi in s for p in range(lo, hi + 1)} for s in spans]
    assert len(starts) == 200 and all(set(range(300, 1001)) <= s for s in starts)  # 701 strings a text
    assert sum(map(len, spans)) < 20 * len(spans)


@pytest.mark.parametrize("kw", [{"roll": 1}, {"docs_a_file": 3}])
def test_token_files_roll(spark, kw):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(i, f"text {i} " * (i % 7)) for i in range(50)] + [(None, "no id"), (60, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = tokenfiles.write_tokens(docs, scratch(spark, "tokens"), path, **kw)
    made = sorted(files.collect(), key=lambda f: (f["part"], f["piece"]))
    assert len({f["path"] for f in made}) == len(made) > 8 and all(f["n_docs"] <= kw.get("docs_a_file", 1) for f in made)
    assert [f["start"] for f in made] == np.cumsum([0, *(f["n_tokens"] for f in made)])[:-1].tolist()
    e = Encoder(path)
    want, at = [], 0
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0])):
        ids = e.encode(t or "") + (2).to_bytes(4, "little")
        want.append((at, i, ids))
        at += len(ids) // 4
    got = sorted((x["start"], x["id"], bytes(x["ids"])) for x in tokenfiles.read_tokens(files).collect())
    assert got == want


def test_payloads_are_exchanged_only_beyond_the_bound(spark):
    rows = [(i, "u", f"{i % 9} " * 100) for i in range(60)] + [(None, "u", "0 " * 100)]
    pages = spark.createDataFrame(rows, "id long, url string, payload string").selectExpr("id", "url", "cast(payload as binary) payload").repartition(2)
    plans, found = [], []
    for bound in (warc.BROADCAST, 0):
        df = warc.roles(pages, "id", "payload", bound)
        found.append(sorted((str(x["id"]), x["digest"], x["refers_to"]) for x in df.collect()))
        plans.append(df._jdf.queryExecution().toString())
    assert found[0] == found[1] and any(x[2] is not None for x in found[0])
    assert "hashpartitioning(digest" not in plans[0] and "BroadcastHashJoin" in plans[0] and "hashpartitioning(digest" in plans[1]


def test_scopes_of_threads_are_their_own(spark):
    other: list[str] = []
    with noted() as paths:
        t = threading.Thread(target=lambda: other.append(scratch(spark, "theirs")))
        t.start()
        t.join()
        with noted() as inner:
            mine = scratch(spark, "mine")
    assert paths == inner == [mine] and other
