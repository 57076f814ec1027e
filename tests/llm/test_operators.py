"""Each operator on a small table of edge cases against a brute-force version."""

import hashlib
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chunking, common, components, decontamination, html_text, lines, mixing, quality, sharding, simhash, suffix, toxicity

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(9)
    words = ["of", "the", "and", *("w" + "".join(r.choices("abcdé", k=4)) for _ in range(80))]
    text = lambda n: " ".join(r.choices(words, k=n))
    shared, long = text(80), text(6000)
    rows = [(i, text(r.randint(0, 120)).replace(" of ", ".\n"), f"s{i % 4}") for i in range(40)]
    rows += [(40 + i, f"{text(9)} {shared} {text(i)}", "s0") for i in range(12)]
    rows += [(60 + i, rows[3][1] + (" x" * (i % 2)), "s1") for i in range(8)]
    rows += [(80, None, None), (81, "", "s1"), (82, " \t\n ", "s2"), (83, long, "s3"), (84, "x" * 700, None), (85, "In. " * 300, "s0"), (None, "alone here", "s0"), (None, None, "s0")]
    rows += [(86, shared, "s2"), (86, shared, "s2"), (87, "one", "s0"), (88, "a\nA\na\n\nb", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """The edge cases of ``corpus`` as a table."""
    return spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in corpus()], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


def same(df, expected):
    got = sorted(map(repr, (tuple(r) for r in df.collect())))
    want = sorted(map(repr, expected))
    assert len(got) == len(want)
    assert [x for x in zip(got, want, strict=True) if x[0] != x[1]][:2] == []


@pytest.mark.parametrize("group", [1500, 4])
def test_op1(docs, empty, group):
    texts = [(t or "").encode() for _, t, _ in corpus()]
    count = Counter(b[i : i + 200] for b in texts for i in range(len(b) - 199))
    out = []
    for (d, _, _), b in zip(corpus(), texts, strict=True):
        m = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                m[i] += 1
                m[i + 200] -= 1
        m = np.cumsum(m)[:-1] > 0
        out.append((d, len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()), hashlib.sha256(bytes(x for x, y in zip(b, m, strict=True) if not y)).hexdigest()))
    same(suffix.remove_repeats(docs, group), out)
    if group == 4:
        assert suffix.remove_repeats(empty).count() == 0


def test_op1_merge():
    """The interleave of shards against sorting all windows."""
    r = random.Random(2)
    texts = ["".join(r.choices("ab", k=r.choice([150, 200, 260, 700]))).encode() for _ in range(30)]
    texts += [t[5:] for t in texts[:10]] + [b"z" * 500]
    count = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for size in (500, 3000, 10**6):
        got = suffix.repeated_windows(texts, size)
        assert [g.tolist() for g in got] == [[count[t[i : i + 200]] > 1 for i in range(max(0, len(t) - 199))] for t in texts]


def test_op1_merges_what_may_repeat(monkeypatch):
    """Contexts that share a mark and no window aren't merged; every repeat is found as by the merge of all."""
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcdefgh ", k=n)).encode()
    mark, passage, merged = text(60), text(230), []
    texts = [text(150) + mark + text(150) for _ in range(300)] + [text(90) + passage + text(70), passage[9:], b"", b"z" * 100]
    shard = suffix.Shard
    monkeypatch.setattr(suffix, "Shard", lambda t: merged.append(len(t)) or shard(t))
    got = suffix.repeated_windows(texts)
    assert 400 < sum(merged) < 500
    assert [g.tolist() for g in got] == [g.tolist() for g in suffix._merged_windows(texts, 24_000)]
    assert [int(g.sum()) for g in got[300:]] == [22, 22, 0, 0] and not any(g.any() for g in got[:300])
    assert [len(g) for g in suffix.repeated_windows([b"", b"a"])] == [0, 0]


def test_op1_long_text():
    """Slices of a long text find the same contexts' windows, each once."""
    data = np.frombuffer("".join(random.Random(1).choices("abcdef ", k=5_000_000)).encode(), np.uint8)
    seen = np.zeros(len(data) - 199, int)
    for _, _, first, last, _ in suffix.contexts(data, np.array([0, len(data)])):
        np.add.at(seen, first, 1)
        np.add.at(seen, last[last + 1 < len(seen)] + 1, -1)
    assert (np.cumsum(seen) == 1).all()


def test_op2():
    r = random.Random(5)
    words = ["".join(r.choices("aeioutrnsl", k=r.randint(3, 9))) for _ in range(400)]
    bad = ["zwirfel", "grompax", "blughkin"]

    def text(toxic):
        w = r.choices(words, k=r.randint(10, 80))
        for _ in range(3 * toxic):
            b = r.choice(bad)
            w.insert(r.randrange(len(w)), b + r.choice(["", "s", "ed", "."]))
        return " ".join(w)

    y = [int(i % 5 == 0) for i in range(500)]
    model = toxicity.train([text(t) for t in y[:300]], y[:300])
    score = model.score([text(t) for t in y[300:]])
    held = np.array(y[300:])
    assert ((score >= 0.3) == held).mean() > 0.97
    assert (model.score(["", None, " \n"]) < 0.3).all() and (model.score(["x" * 100_000]) <= 1).all()
    plain = " ".join(words[:20])
    tricky = [f"{plain} {w} {plain} {w}" for w in ("z-w.i*rfel", "zwirxfel", "z w i r f e l")]
    assert (model.score(tricky) > 5 * model.score([plain + " " + plain])[0]).all()
    assert toxicity.train([], []).score(["a"]).tolist() == [0.0] and toxicity.train(["a b"], [0]).score(["a"]).tolist() == [0.0]


def test_op10_counts_all_trusted(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('w', id % 97, ' x') AS text")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    assert set(quality.ngram_ratio(docs, labels)) == {0.0}  # all are trusted: both multinomials are one


def test_op2_spelled_out_words_of_repeated_letters():
    assert "ass" in toxicity.tokens_of("you are such A s s") and "aaa" in toxicity.tokens_of("a a a") and toxicity.tokens_of("a b") == {"a", "b"}


def _plain_phi(word):
    """The subsequences of four characters within six places of a word with a mark before it, normalised, by enumeration."""
    w = [1, *(toxicity._CODES[ord(c)] for c in word)]
    phi = Counter()
    for p in itertools.combinations(range(len(w)), 4):
        if p[3] - p[0] <= 5:
            phi[tuple(w[i] for i in p)] += toxicity.DECAY ** (p[3] - p[0] - 3)
    norm = sum(toxicity.DECAY ** (2 * (p[3] - p[0] - 3)) for p in itertools.combinations(range(len(w)), 4) if p[3] - p[0] <= 5) ** 0.5
    return {k: v / norm for k, v in phi.items()} if norm else {}


def test_op2_kernel_against_enumeration():
    """Feature map and kernel of words against all their subsequences; gaps and insertions keep most of it."""
    words = ["idiot", "idxiot", "iidiot", "table", "aaaaaa", "abcdefghij", "été1", "abc"]
    plain = [_plain_phi(w) for w in words]
    for i, w in enumerate(words):
        code_of = lambda k: (((k[0] * 64 + k[1]) * 64 + k[2]) * 64 + k[3]) * 0x9E3779B1 % (1 << 32) >> (32 - toxicity._BITS)
        want, got = Counter(), Counter()
        for k, v in plain[i].items():
            want[code_of(k)] += v
        for _, codes, weights in toxicity.features([w]):
            for c, v in zip(codes[0].tolist(), weights.tolist(), strict=True):
                got[c] += v
        assert want.keys() == got.keys() and all(abs(want[c] - got[c]) < 1e-5 for c in want)
    kernel = toxicity._kernel(words, words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        dot = sum(v * plain[j].get(k, 0) for k, v in plain[i].items())
        assert abs(kernel[i, j] - dot) < 0.02  # hashed subsequences may share a slot
    assert kernel[0, 1] > 0.4 and kernel[0, 2] > 0.5 and kernel[0, 3] < 0.05


def test_op2_svm_and_nystrom():
    """The SVM minimises its objective, and landmarks that are the words themselves give the kernel back."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(80, 4)), np.ones((80, 1))], axis=1)
    y = np.where(x[:, 0] + 0.3 * r.normal(size=80) > 0, 1.0, -1.0)
    weights = r.uniform(0.5, 2, 80)
    loss = lambda w: 0.5 * w @ w + 0.5 * (2.0 * weights * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()
    w = toxicity._svm(x, y, 2.0, weights)
    assert all(loss(w) <= loss(w + 1e-3 * d) + 1e-9 for d in r.normal(size=(200, 5)))
    words = ["idiot", "moron", "table", "chairs", "window", "flower"]
    k = toxicity._kernel(words, words).astype(float)
    values, vectors = np.linalg.eigh((k + k.T) / 2)
    mapped = toxicity._kernel(words, words) @ ((vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T)
    assert np.abs(mapped @ mapped.T - k).max() < 0.02


def test_op2_sample_is_bounded_by_rows(spark):
    """An id that repeats very often is one training text."""
    docs = spark.range(5000).selectExpr("id % 2 AS doc_id", "concat('text ', id) AS text")
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    seen = []
    original, toxicity.train = toxicity.train, lambda texts, toxic, base=None: seen.append((texts, toxic)) or toxicity.Model(np.zeros(1, np.float32), 0.0, None, 0.0)
    try:
        toxicity.fit(docs, labels)
    finally:
        toxicity.train = original
    assert len(seen[0][0]) <= 2


def test_op2_frame(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.fit(docs, labels))
    assert out.columns == [*docs.columns, "score", "predicted"] and out.count() == docs.count() and out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score_toxicity(empty, toxicity.fit(empty, labels)).count() == 0
    rows = docs.select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 4 == 2) for r in rows)


def test_op3(docs, empty):
    order = sorted({(d is None, d or 0, t or "") for d, t, _ in corpus()}, key=lambda x: x[:2])
    seen, found = set(), {}
    for null, d, t in order:
        b, at, later = t.encode(), 0, []
        for end in chunking.cuts(np.frombuffer(b, np.uint8)):
            if b[at:end] in seen:
                later.append([at, end])
            seen.add(b[at:end])
            at = end
        spans = []
        for x in later:
            if spans and spans[-1][1] == x[0]:
                spans[-1][1] = x[1]
            else:
                spans.append(list(x))
        spans = [s for s in spans if s[1] - s[0] >= chunking.RUN]
        kept, at = b"", 0
        for a, z in spans:
            kept, at = kept + b[at:a], z
        kept += b[at:]
        found[None if null else d, t] = (len(b), len(chunking.cuts(np.frombuffer(b, np.uint8))), len(later), sum(z - a for a, z in spans), len(spans), hashlib.sha256(kept).hexdigest())
    # Two rows of a null id differ in text only by hash order; neither has chunks in common with the other.
    same(chunking.remove_chunks(docs), [(d, *found[d, t or ""]) for d, t, _ in corpus()])
    assert chunking.remove_chunks(empty).count() == 0


def test_op3_removes_short_repeats(spark):
    r = random.Random(5)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 8))) for _ in range(n))
    short = ["ok.", "Thanks, that works.", text(9)]
    rows = [(i, x) for i, x in enumerate(short * 3)]
    # Passages of 51 words, each in two foreign surroundings: no equal chunk is left in the later one.
    rows += [(100 + i, f"{text(30)} {p} {text(30)}") for i, p in enumerate([text(51) for _ in range(300)] * 2)]
    got = {x["doc_id"]: x for x in chunking.remove_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_removed"] for i in range(9)] == [0, 0, 0] + [len(x) for x in short] * 2
    assert {got[i]["kept_sha256"] for i in range(3, 9)} == {hashlib.sha256(b"").hexdigest()}
    later = [got[400 + i] for i in range(300)]
    assert all((x["n_removed"] > 0) == (x["n_later_chunks"] > 0) for x in later)
    assert any(0 < x["n_removed"] < 96 for x in later) and sum(x["n_removed"] > 0 for x in later) >= 285


def test_op3_cuts_by_a_rolling_hash():
    """Cuts against a gear hash rolled byte by byte."""
    r = random.Random(6)
    for n in (0, 1, 15, 40, 3000):
        for data in (r.randbytes(n), bytes(n), " ".join("".join(r.choices("abc", k=4)) for _ in range(n // 5)).encode()):
            h, ends, last = 0, [], 0
            for i, c in enumerate(data):
                h = ((h << 1) + int(chunking._GEAR[c])) % (1 << 32)
                if i + 1 - last == chunking.MOST + 1:
                    last = i
                    ends.append(last)
                if h >> (32 - chunking.MASK_BITS) == 0 and i + 1 - last >= chunking.LEAST:
                    last = i + 1
                    ends.append(last)
            assert chunking.cuts(np.frombuffer(data, np.uint8)) == (ends if last == len(data) else [*ends, len(data)])


def test_op3_cuts_resist_shifts():
    b = random.Random(3).randbytes(4000)

    def pieces(x):
        ends = chunking.cuts(np.frombuffer(x, np.uint8))
        return [x[a:z] for a, z in zip([0, *ends], ends, strict=False)]

    assert len(set(pieces(b)) - set(pieces(b[:1000] + b"inserted" + b[1000:]))) <= 4
    assert b"".join(pieces(b)) == b
    assert chunking.cuts(np.zeros(0, np.uint8)) == [] and max(np.diff([0, *chunking.cuts(np.zeros(5000, np.uint8))])) <= chunking.MOST


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_op4(docs, empty, hot):
    rows = corpus()
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    gone, seen, first = {i: set() for i in range(len(rows))}, [], {}
    for i in order:
        d, t, _ = rows[i]
        if (d, t) in first:
            gone[i] = gone[first[d, t]]
            continue
        first[d, t] = i
        for j, x in enumerate((t or "").split("\n")):
            s = frozenset(x.encode().translate(LOW).split())
            if s and any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone[i].add(j)
            if s:
                seen.append(s)
    out = []
    for i, (d, t, _) in enumerate(rows):
        x = (t or "").split("\n")
        out.append((d, len(x), len(gone[i]), hashlib.sha256("\n".join(y for k, y in enumerate(x) if k not in gone[i]).encode()).hexdigest()))
    same(lines.remove_lines(docs, hot), out)
    assert lines.remove_lines(empty).count() == 0


def test_op4_sets_in_packets():
    """Copies are collapsed where they are read, then in one part; repeated rows are one place; ids of any type order them, null last."""
    rows = [("b", 7, "x y\nX  y\nz"), (None, 1, "y x"), ("a", 9, "q\ny x x\n\nw" + "\ny x" * 400), ("a", 9, "q\ny x x\n\nw" + "\ny x" * 400), ("a", 3, "w")]

    class Frequent:
        value = np.zeros(0, np.uint64)

    def read(part):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part]), pa.array([r[2].encode() for r in part], pa.binary())], ["doc_id", "__h", "__t"])

    moved = [p for part in (rows[:2], rows[2:]) for b in lines._set_packets(Frequent, 3)(iter([read(part)])) for p in b.to_pylist()]
    assert sum(pa.ipc.open_stream(p["rows"]).read_all().num_rows for p in moved if p["rows"]) == 2 + 3
    moved = pa.RecordBatch.from_pylist(sorted(moved, key=lambda p: p["part"]), pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("gone", pa.binary())]))
    out = [r for b in lines._grouped(iter([moved])) for r in b.to_pylist()]
    assert {(r["doc_id"], r["__h"], r["line"]): r["n"] for r in out if r["n"]} == {("a", 9, 1): 2, ("a", 9, 0): 1, ("a", 3, 0): 1, ("b", 7, 2): 1}
    assert {(r["doc_id"], r["__h"], r["line"]) for r in out if not r["n"]} == {("b", 7, 0), ("b", 7, 1), (None, 1, 0), ("a", 9, 3), *(("a", 9, i) for i in range(4, 404))}


def test_op4_nested_ids():
    ids = [{"a": 2, "b": [1]}, None, {"a": 2, "b": None}, {"a": 2, "b": [1]}, {"a": 3, "b": []}]
    rows = pa.table({"k1": [1] * 5, "k2": [1] * 5, "doc_id": pa.array(ids), "__h": [4] * 5, "line": [0, 0, 1, 0, 0]})
    first, gone = lines._earliest(rows)
    assert first["doc_id"].to_pylist() == [ids[2]] and gone["doc_id"].to_pylist() == [ids[0], ids[0], ids[4], None]


def test_op4_pairs(monkeypatch):
    """Candidates of one part against all pairs of its sets, however few pairs are compared at a time."""
    r = random.Random(4)
    sets = [set(r.sample(range(1 << 20), r.randint(4, 60))) for _ in range(40)]
    sets += [(x - set(r.sample(sorted(x), len(x) // r.choice([6, 12])))) | {r.randrange(1 << 20) for _ in range(len(x) // 12)} for x in sets for _ in range(3)]
    words = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B1) for x in sets]  # under 2^53; their order is that of the numbers
    data = []
    for x in words:
        bit = (x * lines._M2) >> np.uint64(56)
        p = [np.bitwise_xor.reduce(np.where(bit >> np.uint64(6) == w, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))).reshape(1) for w in range(4)]
        data.append([v[0] for v in lines.folded(p, np.array([len(x)]))])
    prefixes = [x[: len(x) - (4 * len(x) + 4) // 5 + 1].astype(np.uint32).view(np.int32) for x in words]
    done = {i for i in range(len(sets)) if i % 7 == 3}
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(sets))), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tolist() for x in prefixes], pa.list_(pa.int32())), *[pa.array(np.array([d[w] for d in data], np.uint64).view(np.int64)) for w in range(4)], pa.array(range(len(sets))), pa.array([5] * len(sets))],
        ["k", "n", "prefix", "s0", "s1", "s2", "s3", "o", "k2"],
    )

    class Done:  # of another second half: not that set
        value = lines._settled(pa.table({"k1": [*sorted(done, reverse=True), 0], "k2": [5] * len(done) + [6]}))

    like = {(i, j) for j in range(len(sets)) for i in range(j) if j not in done and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert len(like) > 20
    found = []
    for most in (1 << 18, 3):
        monkeypatch.setattr(lines, "PAIRS", most)
        packets = [p for b in lines._dealt(1, np.zeros(0, np.int32), Done)(iter([batch])) for p in zip(b["n"].to_pylist(), b["rows"].to_pylist(), strict=True)]
        found.append({tuple(sorted(x)) for x in zip(*(a.tolist() for a in lines._pairs_of(packets)), strict=True)})
    assert found[0] == found[1] >= like and all(max(x) not in done for x in found[0])


def test_op5(docs, empty):
    out = sharding.assign_slots(docs, buckets=4).collect()
    rows = corpus()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert all(r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key" for r in out)
    assert len({(r["doc_id"], r["shard"]) for r in out}) == len({d for d, _, _ in rows})
    assert sharding.assign_slots(empty).count() == 0 and sharding.shard_documents(docs).columns == [*docs.columns, "shard"]


def test_op5_draws_recomputed(docs):
    """Shards of both trees by plain code: the least draw at region, rack and shard."""
    rows = {(r["doc_id"], r["shard"], r["grown_shard"]) for r in sharding.assign_slots(docs, buckets=4).collect()}

    def draw(key, name, weight):
        seed = xxhash.xxh64_intdigest(key.encode(), 42)
        u = ((xxhash.xxh64_intdigest(name.encode(), seed) >> 11) + 0.5) * 2.0**-53
        return -math.log(u) / weight, name

    def pick(key, children):
        return min(children, key=lambda c: draw(key, c[0], c[1]))[2]

    def shard(key, tree):
        region = pick(key, [(f"region {r[0][0][0]}", sum(w for rack in r for _, w in rack), r) for r in tree])
        rack = pick(key, [(f"rack {k[0][0]}", sum(w for _, w in k), k) for k in region])
        return pick(key, [(f"shard {s}", w, s) for s, w in rack])

    tree = sharding.topology()
    assert len(tree) == 2 and [len(r) for r in tree] == [3, 3] and sum(len(k) for r in tree for k in r) == 24
    grown = (*tree, (((24, 1.0),),))
    for d, s, g in rows:
        key = "null" if d is None else str(d)
        assert (s, g) == (shard(key, tree), shard(key, grown))


def test_op5_weights(spark):
    tree = ((((0, 1.0), (1, 2.0)),), (((2, 3.0),),))
    ids = spark.range(60_000).select(sharding.shard_of(F.col("id"), tree).alias("s"), sharding.shard_of(F.col("id"), sharding.grow(tree, 2.0)).alias("g"))
    share = {r["s"]: r["count"] / 60_000 for r in ids.groupBy("s").count().collect()}
    assert all(abs(share[s] - w / 6) < 0.01 for s, w in ((0, 1), (1, 2), (2, 3)))
    assert ids.where("g != s AND g != 3").count() == 0 and abs(ids.where("g = 3").count() / 60_000 - 0.25) < 0.01


def test_op6(docs, empty):
    rows = corpus()
    out = mixing.plan_mix(docs, buckets=3).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((d, s, size(t)) for d, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
            open_.remove(s)
    goal |= {s: level * weight[s] for s in open_}
    # Queues, finish times, one sort of all passes and the truncation at the budget, in plain code.
    key = lambda i: hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}|mix-1|{rows[i][1] or ''}".encode()).hexdigest()
    begin, at = {}, Counter()
    for i in sorted(range(len(rows)), key=lambda i: (int(key(i)[:8], 16) % 3, key(i))):
        begin[i] = at[rows[i][2]]
        at[rows[i][2]] += size(rows[i][1])
    passes = [(i, size(t), s, begin[i] + p * sizes[s]) for i, (_, t, s) in enumerate(rows) for p in (0, 1) if size(t)]
    packets = []
    for x, (_, n, s, at) in enumerate(passes):
        for a, z in ((at, min(at + n, int(goal[s]))), (max(at, int(goal[s])), at + n)):
            if z > a:
                packets.append((z / goal[s], s is None, s or "", a, z - a, x))
    left, of_pass = int(1.5 * sum(sizes.values())), Counter()
    for *_, n, x in sorted(packets):
        of_pass[x] += min(left, n)
        left -= min(left, n)
    taken, whole = Counter(), Counter()
    for x, (i, n, _, _) in enumerate(passes):
        taken[i] += of_pass[x]
        whole[i] += 2 * of_pass[x] >= n
    assert left == 0
    finish = lambda i: (begin[i] + size(rows[i][1])) / goal[rows[i][2]] if goal[rows[i][2]] else None
    same(mixing.plan_mix(docs, buckets=3), [(d, s, size(t), sizes[s], goal[s], taken[i], finish(i)) for i, (d, t, s) in enumerate(rows)])
    for s in names:
        mine = [i for i in range(len(rows)) if rows[i][2] == s]
        assert abs(sum(taken[i] for i in mine) - goal[s]) <= len(names) and all(taken[i] <= 2 * size(rows[i][1]) for i in mine)
    again = mixing.plan_mix(docs.repartition(5), buckets=3).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and mixing.plan_mix(empty).count() == 0
    mixed = mixing.mix_documents(docs.withColumns({"finish": F.lit(1), "__s": F.lit("s"), "SIZE": F.lit(0)}), buckets=3)
    assert mixed.columns == [*docs.columns, "finish", "__s", "SIZE"] and mixing.mix_documents(empty).count() == 0
    want = Counter()
    for i, n in whole.items():
        want[rows[i][0], rows[i][1]] += n
    got = mixed.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == +want
    # In order of finish time: each source's documents come in the order of its queue.
    served = sorted(((at + n) / goal[s], s is None, s or "", at, i) for x, (i, n, s, at) in enumerate(passes) if 2 * of_pass[x] >= n)
    order = [i for *_, i in served if rows[i][0] not in (None, 86)]
    assert [r["doc_id"] for r in got if r["doc_id"] not in (None, 86)] == [rows[i][0] for i in order]


def test_copies(spark):
    """Rows of many copies are dealt in pieces and numbered alike."""
    table = spark.createDataFrame([("a", 3), ("b", 10), ("c", 25), ("d", 1)], "k string, n long")
    got = common.copies(table, "n", "i", most=10).collect()
    assert sorted((r["k"], r["i"]) for r in got) == sorted((k, i) for k, n in (("a", 3), ("b", 10), ("c", 25), ("d", 1)) for i in range(n))


def test_op6_many_sources(spark):
    """More sources than range partitions; all weights and caps as of the plain water filling above."""
    sizes = [(f"s{i:03}", 10 + (i * 37) % 90) for i in range(200)] + [(None, 50)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(sizes)}
    left, open_, goal = 1.5 * sum(n for _, n in sizes), dict(sizes), {}
    while over := [s for s, n in open_.items() if left / sum(weight[x] for x in open_) * weight[s] > 2 * n]:
        for s in over:
            goal[s] = 2 * open_.pop(s)
            left -= goal[s]
    goal |= {s: left / sum(weight[x] for x in open_) * weight[s] for s in open_}
    assert got.keys() == goal.keys() and all(abs(got[s] - goal[s]) < 1e-9 * goal[s] for s in goal)


def brute_fingerprint(t):
    w = (t or "").encode().translate(LOW).split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


@pytest.mark.parametrize("segments", [(3, 1), (5, 2), (7, 4)])
def test_op7(docs, empty, segments):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    got = simhash.near_duplicates(docs, segments=segments)
    same(got.selectExpr("doc_id", "fp", "component_id"), [(d, f - (1 << 64) if f >> 63 else f, least.get(find(i))) for i, ((d, _, _), f) in enumerate(zip(rows, fps, strict=True))])
    if segments == (3, 1):
        kept = simhash.keep_one(docs.withColumns({c: F.lit(1) for c in ("__i", "__h", "many", "c", "n", "best", "fp", "root")}))
        assert kept.columns == [*docs.columns, "__i", "__h", "many", "c", "n", "best", "fp", "root"] and kept.count() == len({find(i) for i in range(len(rows))})
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(x for x in ids if x is not None) == sorted(least.values())
        assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("segments", simhash.PLANS)
def test_op7_links(spark, segments):
    """Random fingerprints, dense groups and chains: no link is lost, at any distance up to 4, and none is made."""
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(60)]
    near = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 7))) for b in base for _ in range(12)} | set(base)
    dense = r.getrandbits(64)
    near |= {dense ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 3))) for _ in range(300)}
    for _ in range(40):  # steps of exactly four bits, spread over the segments
        near.add(dense := dense ^ sum(1 << i for i in r.sample(range(64), 4)))
    near = list(near)
    signed = [simhash._signed(x) for x in near]
    fps = common.cut(spark.createDataFrame([(x,) for x in signed], "fp long"))
    out = {x["fp"]: x["root"] for x in simhash.link_fingerprints(fps, segments=segments).collect()}
    group = {x: x for x in near}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in near:
        for b in near:
            if (a ^ b).bit_count() <= 4:
                group[find(a)] = find(b)
    roots = {}
    for x, s in zip(near, signed, strict=True):
        roots.setdefault(find(x), set()).add(out[s])
    assert all(len(v) == 1 for v in roots.values()) and len(set.union(*roots.values())) == len(roots)


def test_op7_plans():
    """Pigeonhole: four bits anywhere leave some j of m segments with at most one; the plan follows the number of fingerprints."""
    r = random.Random(1)
    for p in simhash.PLANS:
        assert simhash.radius(*p) == 1
        for _ in range(3000):
            x = sum(1 << i for i in r.sample(range(64), 4))
            assert min((x & m).bit_count() for m in simhash.masks(*p)) <= 1
    assert [simhash.plan(n) for n in (10, 10**5, 10**8, 10**10, 10**12)] == [(3, 1), (3, 1), (6, 3), (7, 4), (8, 5)]


def test_op7_dense_group_is_not_joined_with_itself(spark):
    """One component of many fingerprints: its buckets are one row each."""
    fps = common.cut(spark.range(3000).selectExpr("id AS fp"))  # twelve low bits: all within one component
    roots = simhash.link_fingerprints(fps)
    assert {x["root"] for x in roots.select("root").distinct().collect()} == {0} and roots.count() == 3000


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (5, 5), (200, 100)], "u long, v long")
    out = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert {out[i] for i in range(2, 41)} == {1} and {out[i] for i in (101, 102, 200)} == {100} and 5 in out


@pytest.mark.parametrize("most", [components.EDGES, 10])
def test_components_of_random_edges(spark, most):
    """Settled by one task and by rounds of stars alike; every node but the roots, once."""
    r = random.Random(5)
    edges = [(r.randrange(-900, 900), r.randrange(-900, 900)) for _ in range(900)] + [(2**62 + i, -(2**62) - i) for i in range(50)]
    group = {x: x for e in edges for x in e}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for u, v in edges:
        group[max(find(u), find(v))] = min(find(u), find(v))
    out = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(7), most)
    assert sorted((x["node"], x["root"]) for x in out.collect()) == sorted((x, find(x)) for x in group if x != find(x))


def test_op7_executions_of_the_driver(spark):
    """A chain costs the driver no more executions, with their plans and threads, than a pair: it is settled by one task."""
    counts = []
    for n in (2, 2000):
        edges = spark.range(n).selectExpr("id AS u", "id + 1 AS v")
        before = spark._jsparkSession.sharedState().statusStore().executionsCount()
        assert {x["root"] for x in components.connected_components(edges).collect()} == {0}
        counts.append(spark._jsparkSession.sharedState().statusStore().executionsCount() - before)
    assert counts[0] == counts[1] <= 5


def _plans(spark, run):
    """The last plan of each execution of ``run``."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    spark.range(1).count()
    bus.waitUntilEmpty()
    before = max(x.executionId() for x in (store.executionsList().apply(i) for i in range(store.executionsList().size())))
    run()
    bus.waitUntilEmpty()
    found = store.executionsList()
    return [x.physicalPlanDescription() for x in (found.apply(i) for i in range(found.size())) if x.executionId() > before]


@pytest.mark.parametrize("of", [simhash.near_duplicates, simhash.keep_one])
def test_op7_broadcasts_nothing(spark, of):
    """Exploded fingerprints look small to Spark: at 0.6 GB their broadcast was more than the driver's memory."""
    texts = [f"{w} common words that many texts share {w}" for w in range(40)]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts * 2)], "doc_id long, text string")
    plans = _plans(spark, lambda: of(docs).write.format("noop").mode("overwrite").save())
    assert len(plans) >= 8 and any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_components_broadcast_nothing(spark):
    edges = spark.range(50).selectExpr("id AS u", "id + 1 AS v")
    plans = _plans(spark, lambda: components.connected_components(edges, 10).count())
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_op6_copies_are_not_broadcast(spark):
    """Rows of the mix are exploded from one for each different document: however few those are, their copies can be many."""
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y")] + [(3, "f g", "x")] * 500, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(docs)
    assert re.search(r"\w+Join", mixed._jdf.queryExecution().executedPlan().toString()).group() == "SortMergeJoin"
    assert mixed.where("doc_id = 3").count() > 500


def test_op8():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="main-menu"><a href=x>Home</a></div><div class=cookie-notice>We use cookies, sorry.</div>
<div class="content"><h1>A title</h1><p>First &amp; long, with text; it is about things,
 and   more.<p>Second, with <b>bold</b> words, and so on.<ul><li>one<li>two</ul></div><aside>Related, things.</aside><div class="comments"><p>Great, thanks, really, a lot.</p></div><form>Name, please</form><footer>c</footer><script>x="<p>no</p>"</script>"""
    assert html_text.extract(page) == "A title\nFirst & long, with text; it is about things, and more.\nSecond, with bold words, and so on.\none\ntwo"
    assert [html_text.extract(x) for x in ("", None, "plain &lt;text", "<p>a<!-- cut", "<p>a</p><", "<nav>x</nav>", "<p>a < b</p>")] == ["", "", "plain <text", "a", "a", "", "a < b"]
    article = "<nav>m</nav><article><h1>H</h1><p><b>Open.<br><p>Two, three.</article><footer>f</footer>"
    assert html_text.extract(article) == "H\nOpen.\nTwo, three."
    assert html_text.extract("<div>" * 3000 + "deep text, here." + "</div>" * 3000) == "deep text, here."


def test_op8_wrappers_with_listed_names():
    story = "".join(f"<p>Paragraph {i} of the story, with some text; it goes on, and on.</p>" for i in range(5))
    want = html_text.extract(f"<div>{story}</div>")
    rest = '<div class="comments"><p>A remark, short.</p></div><div class="sidebar-left"><p>Elsewhere, today.</p></div>'
    for attribute in ('class="content has-sidebar"', "class=no-sidebar", "class=content-sidebar-wrap", "class=with-comments", "id=legal"):
        for page in (f"<main>{story}</main>", f"<article>{story}</article>", f"<div>{story}</div>"):
            assert html_text.extract(f"<body><div {attribute}>{page}{rest}</div></body>") == want
            assert html_text.extract(f"<body><div {attribute}>{page}</div>{rest}</body>") == want
    # What isn't a wrapper still goes, however long it is.
    talk = "".join(f"<article class=comment><p>Remark {i}, longer than the story; it goes on, and on, and on.</p></article>" for i in range(20))
    for page in (f"<article>{story}</article>", f"<div>{story}</div>"):
        assert html_text.extract(f"<body>{page}<div class=comments>{talk}</div></body>") == want
        assert html_text.extract(f"<body><div id=legal>{page}<div class=comments>{talk}</div></div></body>") == want
    assert html_text.extract('<div class="menu"><a href=x>Home</a></div>') == html_text.extract(f"<nav>{story}</nav>") == ""


def test_op8_several_articles():
    part = lambda k, n: "".join(f"<p>Part {k}, paragraph {i} of the story; it goes on, and on.</p>" for i in range(n))
    for sizes in ((5, 4, 3), (6, 5), (4, 4, 4)):
        parts = [f"<article><h2>Head {k}</h2>{part(k, n)}</article>" for k, n in enumerate(sizes)]
        want = "\n".join(html_text.extract(x) for x in parts)
        assert html_text.extract("<body><div><a href=x>Home</a></div>" + "".join(parts) + "</body>") == want
        assert html_text.extract("<body>" + "".join(f"<section>{x}</section>" for x in parts) + "</body>") == want


def _soup(r):
    """A page of divs whose class names mean nothing: [(tag path, text, characters of links)] and its html."""
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=5)) + r.choice(["", "", "", ",", "."]) for _ in range(n))
    blocks, parts = [], []
    for k in range(r.randint(3, 9)):
        label = f"div.q{r.randint(0, 5)}"
        inner = r.choice([(), (), ("section",), ("aside",)])
        parts.append(f"<{label[:3]} class={label[4:]}>" + "".join(f"<{t}>" for t in inner))
        for _ in range(r.randint(1, 5)):
            tag, linked, t = r.choice(["p", "p", "p", "h2", "li"]), r.random() < 0.2, words(r.choice([2, 8, 60]))
            parts.append(f"<{tag}><a href=x>{t}</a></{tag}>" if linked else f"<{tag}>{t}</{tag}>")
            blocks.append((("", "html", "body", label, *inner, tag), t, len(t) if linked else 0))
        parts.append("".join(f"</{t}>" for t in inner) + "</div>")
    return blocks, "<html><body>" + "".join(parts) + "</body></html>"


def _plain_content(blocks):
    """The texts of content paths, steps 1 to 4 of the module in plain code over whole paths."""
    sums = {}
    for path, text, linked in blocks:
        s = sums.setdefault(path, [0, 0, 0, 0])
        for i, x in enumerate((len(text), sum(c in ".,;:!?-" for c in text), linked, 1)):
            s[i] += x
    paths = list(sums)
    alike = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) / max(len(a), len(b))
    ratio = [[s[0] / s[3] for s in sums.values()], [(s[1] + 0.5) / s[3] for s in sums.values()]]
    fused = []
    for i, p in enumerate(paths):
        near = {j: np.exp(-((i - j) ** 2) / 2) * alike(p, paths[j]) for j in range(len(paths)) if abs(i - j) <= 2}
        a, b = (min(3 * x[i], sum(w * x[j] for j, w in near.items()) / sum(near.values())) for x in ratio)
        chars, _, linked, n = sums[p]
        fused.append((a * b) ** 0.5 * (1 - linked / chars) * n**0.25 * (html_text.LOW if "aside" in p else 1))
    least = max(html_text.FLOOR, min(html_text.THRESHOLD * (np.std(fused) + np.mean(fused)), max(fused)))
    chosen = {p for p, v in zip(paths, fused, strict=True) if v >= least * (1 - 1e-12)}
    return [t for p, t, _ in blocks if p in chosen]


def test_op8_ratios_against_plain_version():
    r = random.Random(3)
    chosen = 0
    for _ in range(200):
        blocks, page = _soup(r)
        read = html_text._Reader(page)
        html_text._weigh(read.nodes, read.blocks, False)
        content = html_text.content_paths(html_text.paths_of(read.nodes, read.blocks))
        want = _plain_content(blocks)
        assert [b.text for b in read.blocks] == [t for _, t, _ in blocks]
        assert [b.text for b in read.blocks if b.node.path in content] == want
        chosen += 0 < len(want) < len(blocks)
    assert chosen > 100


def test_op8_ratios_decide(monkeypatch):
    """No article, no telling names: ratios find the story, and without them the result is another."""
    story = "".join(f"<p>Paragraph {i} of the story, which has some text in it; it goes on, and on.</p>" for i in range(5))
    page = f"<body><div class=k1><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div><div class=k2>Buy now</div><div class=k3><h2>Head</h2>{story}</div><div class=k4>2020</div></body>"
    want = html_text.extract(f"<article><h2>Head</h2>{story}</article>")
    assert html_text.extract(page) == want and want.startswith("Head\nParagraph 0")
    article = f"<nav><a href=x>One</a></nav><div class=ad>Buy now.</div><article><h1>Head</h1>{story}</article><footer>2020</footer>"
    before = html_text.extract(article)
    assert before == want
    monkeypatch.setattr(html_text, "ratios", lambda paths: [1.0] * len(paths))
    assert html_text.extract(page) != want and html_text.extract(article) != before


def test_op8_hostile_pages():
    """Depth and unclosed tags cost linear time and memory."""
    tracemalloc.start()
    assert html_text.extract("<div>" * 100_000 + "deep text, here." + "</div>" * 100_000) == "deep text, here."
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    for page in ("<b>" * 50_000 + "<p>x" * 20_000, "<div>" * 50_000 + "</span>" * 50_000, "<table><tr><td>" * 20_000 + "<tr>" * 20_000, "<tr><table>" + "<div>" * 50_000 + "<tr>" * 20_000):
        began = time.process_time()
        html_text.extract(page)
        assert time.process_time() - began < 20


def test_op8_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Some text, here.</p>", "x"), (2, None, None, "y")], "page_id long, url string, html string, other string")
    assert [tuple(r) for r in html_text.extract_pages(pages).collect()] == [(1, "u", "<p>Some text, here.</p>", "x", "Some text, here.", 16), (2, None, None, "y", "", 0)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    clash = pages.withColumns({"TEXT": F.lit("a"), "n_chars": F.lit("b"), "a.b": F.lit(1)})
    assert html_text.extract_pages(clash).columns == ["page_id", "url", "html", "other", "a.b", "text", "n_chars"] and html_text.extract_pages(clash).first()["text"] == "Some text, here."
    assert html_text.extract_pages(pages.select(F.col("html").alias("text")), "text").first()["text"] == "Some text, here."


@pytest.mark.parametrize("most", [250_000, 3])
def test_op9(spark, docs, empty, most):
    rows = corpus()
    items = [("b", rows[40][1].split(" ", 12)[-1][:300]), ("a", rows[0][1]), ("c", "alone HERE"), ("d", None), ("e", "..."), (None, "one"), ("b", "one"), ("f", " ".join(rows[63][1].split()[500:514]))]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall((t or "").encode().translate(LOW).decode())
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i or "")
    out = []
    for d, t, _ in rows:
        w, hit, names = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit |= set(range(j, j + k))
                    names |= windows[tuple(w[j : j + k])]
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    same(decontamination.mark(docs.select("doc_id", "text"), bench, max_windows=most).drop("text"), out)
    if most == 3:
        assert decontamination.mark(docs, bench.limit(0)).where("n_hit > 0 OR n_items > 0").count() == 0 and decontamination.decontaminate(empty, bench).count() == 0


@pytest.mark.parametrize("most", [250_000, 3])
def test_op9_stage_drops_any_full_passage(spark, most):
    """A passage that is 1 % of a long text, and one cut short by a word."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    item, short = text(40), "very common words"
    rows = [(1, f"{text(1500)} {' '.join(item.split()[10:23])} {text(1500)}"), (2, f"{text(1500)} {' '.join(item.split()[10:22])} {text(1500)}"), (3, f"{text(200)} {short} {text(200)}"), (4, f"{short} {text(10)}"), (5, None), (6, text(9))]
    docs = spark.createDataFrame([(i, t, "mine", "mine") for i, t in rows], "doc_id long, text string, n_words string, contaminated string")
    bench = spark.createDataFrame([("a", item), ("b", short)], "item_id string, text string")
    kept = decontamination.decontaminate(docs, bench, max_windows=most)
    assert kept.columns == docs.columns and {tuple(x) for x in kept.collect()} == {(i, t, "mine", "mine") for i, t in rows if i not in (1, 4)}
    marked = decontamination.mark(docs, bench, max_windows=most)
    assert marked.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["contaminated"]) for x in marked.collect()} == {1: (3013, 13, False), 2: (3012, 0, False), 3: (403, 3, False), 4: (13, 3, True), 5: (0, 0, False), 6: (9, 0, False)}


def test_op10_ratio_by_hand(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, None), (None, "a"), (1, "a b a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 0), (9, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, good = Counter(), Counter()
    for d, t in rows:
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in (t or "").split()]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(h, h[1:], strict=False)]
        for x in (*h, *two):
            raw[x % quality.BUCKETS] += 1
            good[x % quality.BUCKETS] += d == 1
    want = [math.log((good[i] + 1) / (sum(good.values()) + quality.BUCKETS)) - math.log((raw[i] + 1) / (sum(raw.values()) + quality.BUCKETS)) for i in range(quality.BUCKETS)]
    assert np.allclose(quality.ngram_ratio(docs, labels), want, atol=1e-12)


def test_op10(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(50)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = quality.ngram_ratio(docs, labels)
    out = []
    for d, t, _ in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n, cover = Counter(win), set()
        for i, x in enumerate(win):
            if n[x] > 1:
                cover |= set(range(i, i + 8))
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        signed = [x - (1 << 64) if x >> 63 else x for x in h]
        two = [xxhash.xxh64_intdigest((b & (1 << 64) - 1).to_bytes(8, "little"), xxhash.xxh64_intdigest((a & (1 << 64) - 1).to_bytes(8, "little"), 42)) for a, b in zip(signed, signed[1:], strict=False)]
        grams = [x % quality.BUCKETS for x in (*h, *two)]
        llr = sum(ratio[g] for g in grams) / max(1, len(grams))
        out.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(cover), failed, not failed and llr >= quality.THRESHOLD))
    same(quality.score_quality(docs.select("doc_id", "text"), ratio).drop("text", "llr"), out)
    assert quality.score_quality(empty, ratio).count() == 0 and set(quality.ngram_ratio(docs, labels.limit(0))) == {0.0}


OWN = [
    "score", "predicted", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "full", "kept", "llr", "base_failed", "n_symbols", "shard", "slot", "size", "source_size", "target", "taken", "fp", "component_id", "text_crc32", "law",
    "n_bytes", "n_removed", "kept_sha256", "c0", "c1", "t", "k", "s", "n", "b", "p", "v", "root", "best", "least", "finish", "last", "at", "many", "runs", "found", "key", "words", "one", "two", "four", "eight", "own", "doc.id",
    *(f"{u}{x}" for u in ("__", "___") for x in ("id", "h", "t", "s", "d", "k", "i", "c", "n", "m", "z", "finish", "many", "w", "words", "one", "two", "key", "there", "full", "row", "of", "piece", "html", "size", "score")),
]


def _functions(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("a", "alone here")], "item_id string, text string")
    model = toxicity.train(["a zwirfel b", "c d", "zwirfel e", "f g"] * 5, [1, 0] * 10)
    keeps = {
        "score_toxicity": lambda d: toxicity.score_toxicity(d, model), "mark": lambda d: decontamination.mark(d, bench), "mark_blocks": lambda d: decontamination.mark(d, bench.unionAll(bench), max_windows=1),
        "decontaminate": lambda d: decontamination.decontaminate(d, bench), "score_quality": lambda d: quality.score_quality(d, [0.5] * quality.BUCKETS), "shard_documents": sharding.shard_documents,
        "keep_one": simhash.keep_one, "mix_documents": mixing.mix_documents, "extract_pages": lambda d: html_text.extract_pages(d, "text").drop("text").withColumn("text", F.col("lang")),
    }
    digests = {
        "remove_repeats": suffix.remove_repeats, "remove_chunks": chunking.remove_chunks, "remove_lines": lines.remove_lines, "assign_slots": sharding.assign_slots, "plan_mix": mixing.plan_mix, "near_duplicates": simhash.near_duplicates,
        "ngram_ratio": lambda d: spark.createDataFrame([(x,) for x in quality.ngram_ratio(d, labels)[:50]], "x double"),
    }
    return keeps, digests


@pytest.mark.parametrize("name", ["score_toxicity", "mark", "mark_blocks", "decontaminate", "score_quality", "shard_documents", "keep_one", "mix_documents", "extract_pages", "remove_repeats", "remove_chunks", "remove_lines", "assign_slots", "plan_mix", "near_duplicates", "ngram_ratio"])
def test_names_that_clash(spark, name):
    """Columns named like an operator's results and its internals: results stay, the others of the caller are kept."""
    plain = spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in corpus()[:60:3] + corpus()[-12:]], "doc_id long, text string, lang string, source string, n_chars long")
    clash = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(OWN)])
    keeps, digests = _functions(spark)
    apply = (keeps | digests)[name]
    want, got = apply(plain), apply(clash)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    results = [c for c in want.columns if c not in ("text",) or name != "extract_pages"]
    same(got.select(*[common.col(c) for c in results]), [tuple(r) for r in want.select(*results).collect()])
    if name in keeps:
        kept = [c for c in OWN if c not in want.columns]
        assert set(kept) <= set(got.columns)
        places = [OWN.index(c) for c in kept]
        assert all(tuple(r) == tuple(places) for r in got.select(*map(common.col, kept)).limit(5).collect())
