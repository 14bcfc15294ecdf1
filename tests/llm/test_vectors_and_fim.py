"""Fill-in-middle, nearest vectors and vector codes against plain versions, and on awkward rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import codes, fim, srs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [
    None, "", " ", "a", " \t\n", "one two  three\n\n", "éa bü 漢字 😀😀 x", "a <P> b", "<S", "x <M", "漢" * 500, "<" * 9 + " " + ">" * 9,
    "no break space\x00zero \x85 y", " lead", "trail ", "é", "😀 ", "w " * 30_000 + "ß",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "clash") for i in range(150)] + [(None, "null id here", None), (907, "a b c d", ""), (907, "a b c d", "")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, output string")


def some_first(row):
    return tuple((x is not None, x) for x in row)


def test_fim_equals_plain(awkward):
    got = sorted((tuple(r) for r in fim.report(awkward).collect()), key=some_first)
    want = sorted((plain_fim(r["doc_id"], r["text"]) for r in awkward.collect()), key=some_first)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_by_characters_and_bytes(awkward):
    texts = {(r["doc_id"]): r["text"] for r in awkward.collect()}
    got = fim.restore(fim.fill_in_middle(awkward, unit="char", rate=100)).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["n"] == len(text) and r["text"] == text
        if r["form"] != "plain":
            p, m = text[: r["prefix_chars"]], text[r["prefix_chars"] : r["prefix_chars"] + r["middle_chars"]]
            assert (len(p.encode()), len(m.encode())) == (r["prefix_bytes"], r["middle_bytes"])
            assert r["output"].endswith("<M>" + m)
    assert sum(r["form"] != "plain" for r in got) > 80


def test_fim_in_other_partitions_and_empty(awkward):
    one, many = (sorted((tuple(r) for r in fim.report(awkward.repartition(n)).collect()), key=some_first) for n in (1, 40))
    assert one == many
    assert fim.report(awkward.limit(0)).collect() == []


def test_wide_index_round_trip():
    text = "aé漢😀b" * 40
    data = np.frombuffer(text.encode(), np.uint8)
    wide = fim.Wide.of(data)
    points = np.arange(len(text) + 1)
    at = np.array([len(text[:k].encode()) for k in points])
    assert (wide.to_bytes(points) == at).all() and (wide.to_points(at) == points).all()
    assert len(fim.Wide.of(np.frombuffer(b"ascii only", np.uint8)).byte) == 0


# -- nearest vectors -----------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, cell int")


def brute_nearest(rows, every, k):
    """Lists of (vec_id, score) of each distinct query, one own row left out."""
    usable = [(i, tuple(v)) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, v in sorted({(i, v) for i, v in usable if i is not None and i % every == 0}):
        rest = list(usable)
        rest.remove((i, v))
        scored = []
        for j, w in rest:
            s = 0.0
            for a, b in zip(v, w, strict=True):
                s += a * b
            scored.append((-s, j is None, j))
        out[(i, v)] = [(j, -s) for s, _, j in sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k]]
    return out


def answers(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: [(v, s) for _, v, s in sorted(x, key=lambda t: t[0])] for q, x in out.items()}


def test_nearest_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)], 0, i) for i in range(400)]  # whole numbers: many ties
    rows += [(1000 + i, [1.0, 2.0, 0.0, -1.0, 0.0, 3.0], 1, 0) for i in range(300)]  # a hot vector, some of it queries
    rows += [(2000, None, 0, 0), (2020, [0.0] * 6, 0, 0), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 0)]
    rows += [(2060, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0], 0, 0), (2080, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0, 0)]
    rows += [(None, [3.0, 3.0, 3.0, 3.0, 3.0, 3.0], None, None)] * 2 + [(20, rows[20][1], 0, 0)]  # null ids, a repeated row
    want = {q: x for (q, _), x in brute_nearest(rows, 20, 20).items()}
    for cell in (4096, 40):
        got = answers(srs.nearest(vectors(spark, rows), certainty=0.9999, cell=cell, leaf=16))
        assert got == want


def test_nearest_few_rows(spark):
    assert srs.nearest(vectors(spark, [])).collect() == []
    assert srs.nearest(vectors(spark, [(0, [1.0, 2.0], 0, 0)])).collect() == []
    got = answers(srs.nearest(vectors(spark, [(0, [1.0, 2.0], 0, 0), (1, [1.0, 0.0], 0, 0), (3, [0.5, 0.25], 0, 0)])))
    assert got == {0: [(1, 1.0), (3, 1.0)]}
    with pytest.raises(ValueError, match="one length"):
        srs.nearest(vectors(spark, [(0, [1.0, 2.0], 0, 0), (1, [1.0], 0, 0)]))


@pytest.mark.parametrize("cell", [4096, 300])
def test_nearest_recall(spark, cell):
    from conftest import SF

    df = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = {q: x for (q, _), x in brute_nearest(rows, 20, 20).items()}
    got = answers(srs.nearest(df, cell=cell, certainty=0.9))
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {q: dict(x) for q, x in want.items()}
    assert all(exact[q].get(v, s) == s for q, x in got.items() for v, s in x)
    assert all(len(x) == 20 for x in got.values())


def test_search_stops_early_on_clusters():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32)) * 3
    x = (centres[:, None, :] + 0.1 * rng.standard_normal((60, 100, 32))).reshape(-1, 32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    space = srs.Space.of(32, 8, float(np.sqrt((x * x).sum(1).max())) * (1 + 1e-12), 42)
    group = srs.Group(x, [np.array([i]) for i in range(len(x))], space, 64)
    q = x[::100]
    chi = srs.chi_square(0.97, 8)
    who, row = group.search(q, np.full(len(q), -np.inf), 10, chi)
    assert group.verified < 0.35 * len(q) * len(x)
    hits = 0
    for i in range(len(q)):
        best = set(np.argsort(-(x @ q[i]))[:10].tolist())
        hits += len(best & set(group.order[row[who == i]].tolist()))
    assert hits >= 0.95 * 10 * len(q)


def test_chi_square():
    # Tabulated quantiles.
    assert srs.chi_square(0.95, 2) == pytest.approx(5.991, abs=1e-3)
    assert srs.chi_square(0.95, 8) == pytest.approx(15.507, abs=1e-3)
    assert srs.chi_square(0.99, 16) == pytest.approx(32.000, abs=1e-3)


def test_boxes_hold_their_points():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.standard_normal((500, 4)), np.zeros((300, 4))])
    boxes = srs.Boxes.fit(points, 16)
    at = boxes.cell(points)
    away = boxes.distances(points)
    assert (away[np.arange(len(points)), at] == 0).all() and len(np.unique(at)) > 8
    alone = srs.Boxes.fit(np.zeros((9, 4)), 8)
    assert (alone.cell(points) == 0).all()


# -- codes ---------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [r for r in rows if r[1] is not None and all(c is not None and np.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [np.floor(1024 * c) for c in r[1]]))
    q = np.array([[int(np.floor(1024 * c)) for c in r[1]] for r in kept], np.int64)
    length = q.shape[1] // parts
    books, picks = [], []
    for p in range(parts):
        x = q[:, p * length : (p + 1) * length]
        book = x[:entries].copy()
        for turn in range(rounds + 1):
            d = ((x[:, None, :] - book[None]) ** 2).sum(2)
            at = d.argmin(1)
            if turn < rounds:
                for e in range(len(book)):
                    if (at == e).any():
                        book[e] = x[at == e].sum(0) // (at == e).sum()
        books.append(book)
        picks.append((at, d[np.arange(len(x)), at]))
    error = sum(d for _, d in picks)
    code = ["".join(f"{a[i]:02x}" for a, _ in picks) for i in range(len(kept))]
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.reshape(-1)).encode()).hexdigest()
    total = defaultdict(int)
    for r, e in zip(kept, error, strict=True):
        total[r[2]] += int(e)
    return [(r[0], c, int(e), total[r[2]], digest) for r, c, e in zip(kept, code, error, strict=True)]


@pytest.mark.parametrize("n", [900, 40])
def test_codes_equal_plain(spark, n):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.002, 8)], int(i) % 5, 1) for i in rng.permutation(n)]  # few distinct parts: ties
    rows += [(5000 + i, [0.25] * 8, None, 1) for i in range(n // 2)]  # a third of all rows alike, null labels
    rows += [(None, [-1.5] * 8, 3, 1), (6000, None, 0, 1), (6001, [None] + [1.0] * 7, 0, 1), (6002, [float("nan")] * 8, 0, 1)]
    rows += [(3, [0.5] * 8, 9, 1), (3, [-0.5] * 8, 9, 1), (3, [0.5] * 8, 9, 1)]  # one id, two vectors, one of them twice
    want = sorted(brute_codes(rows), key=some_first)
    for partitions in (1, 23):
        got = codes.report(vectors(spark, rows).repartition(partitions))
        assert sorted((tuple(r) for r in got.collect()), key=some_first) == want


def test_codes_empty_and_refused(spark):
    assert codes.report(vectors(spark, [])).collect() == []
    assert codes.report(vectors(spark, [(1, None, 0, 0)])).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.report(vectors(spark, [(1, [1.0] * 6, 0, 0)]))
    with pytest.raises(Exception, match="64 bits"):
        codes.report(vectors(spark, [(1, [1e30] * 8, 0, 0)])).collect()


def test_trie_shares_prefixes(monkeypatch):
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 3, (4000, 9)), axis=0)
    entries = rng.integers(0, 3, (50, 9))
    steps = []
    plain = codes.Trie._step
    monkeypatch.setattr(codes.Trie, "_step", lambda self, v, d: steps.append(len(v)) or plain(self, v, d))
    nearest, distance = codes.Trie(rows, entries).walk()
    all_distances = ((rows[:, None, :] - entries[None]) ** 2).sum(2)
    assert (nearest == all_distances.argmin(1)).all() and (distance == all_distances.min(1)).all()
    nodes = sum(len(np.unique(rows[:, : d + 1], axis=0)) for d in range(9))
    assert sum(steps) <= 1.1 * nodes < 0.35 * rows.size
