"""The training-data operators against plain versions, and on awkward rows."""

import hashlib
import itertools
import os
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from weftline.llm import decontaminate, linecrf, mixing, neardup, pu, repeats, sharding, substrings, suffixarray, toxicity, warc  # noqa: E402
from weftline.llm.components import _print, components  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, hits long, size long"


def rows_of(*texts, start=0):
    return [(start + k, t, "en", f"s{k % 3}" if k % 4 else None, len(t or ""), "x", 0.5, 1, 2) for k, t in enumerate(texts)]


LONG = " ".join(f"w{k}x{k * k % 997}" for k in range(30000))
BASE = " ".join(f"tok{k}" for k in range(120))
AWKWARD = [
    *rows_of(None, "", " \n\t ", "one", "two words", BASE, BASE, BASE + " extra tail", "pre " + BASE, LONG, "ÄÖ ß é\n\nx", "a\0b " * 40, LONG[:-9]),
    (None, BASE, None, None, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None),
    (5, BASE, "en", "s1", 3, "x", 0.5, 1, 2),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)] + [(None, 1, None)], "doc_id long, quality int, toxic int")


def plain(df):
    return [r.asDict() for r in df.collect()]


def spans(tokens, length):
    """For each (id, tokens): which tokens go (the rule itself, id by id)."""
    first = {}
    for d, t in tokens:
        for i in range(len(t) - length + 1):
            key = t[i : i + length]
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in tokens:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def words_removed(rows):
    cut = [(10**15 if r[0] is None else r[0], tuple(WORD.findall(r[1] or ""))) for r in rows]
    out = []
    for (_, t), gone, r in zip(cut, spans(cut, 50), rows):
        kept = " ".join(w for w, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def bytes_removed(rows):
    cut = [(10**15 if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    out = []
    for (_, t), gone, r in zip(cut, spans(cut, 50), rows):
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [4000, 0])
def test_repeats(spark, docs, awkward, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)  # 0: every differing anchor goes the way of the very frequent ones
    for df in (awkward, docs.limit(120)):
        df = df.select("doc_id", "text").persist()
        rows = [tuple(r) for r in df.collect()]
        got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in plain(substrings.remove_repeats(df)))
        assert got == words_removed(rows)
        got = Counter(tuple(r[k] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in plain(suffixarray.remove_repeats(df)))
        assert got == bytes_removed(rows)


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def linked(rows):
    parent = {d: d for d, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, shingle_set(t)) for d, t in rows]
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {d: top(d) for d in parent}


def test_near_duplicates(spark, docs, awkward):
    # a chain: neighbours are linked, the ends are not; members of a band reach each other through others only
    chain = [(100 + k, " ".join(f"c{j}" for j in range(4 * k, 4 * k + 90))) for k in range(12)]
    for rows in ([(r["doc_id"], r["text"]) for r in docs.collect()] + [(d + 10**6, t) for d, t in chain], [r[:2] for r in AWKWARD if r[0] is not None]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = linked(rows)
        got = plain(neardup.near_duplicates(df))
        assert len(got) == len(rows)
        for r in got:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    got = plain(neardup.near_duplicates(awkward))
    assert len(got) == len(AWKWARD) and all(r["kept"] for r in got if r["doc_id"] is None)
    assert neardup.drop_near_duplicates(awkward).columns == awkward.columns


def test_cross_links_inside_blocks():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = rng.integers(1, 2**32, 300, dtype=np.uint64).astype(np.uint32)
    sets = [np.unique(np.concatenate((base[:280], rng.integers(1, 2**32, 10, dtype=np.uint64).astype(np.uint32)))) for _ in range(6)]
    same = np.arange(128, dtype=np.uint32).tobytes()
    table = pa.table({"doc": list(range(6)), "comp": list(range(6)), "stray": [k > 0 for k in range(6)], "band": [0] * 6, "bins": [same] * 6, "hashes": [s.tobytes() for s in sets]})
    out = neardup.across(80)((pa.scalar(1), pa.scalar(0)), table)
    assert out.num_rows == 5  # one link fewer than members


def test_crowded_bands(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    own = lambda k: [f"u{k}" for k in rng.integers(0, 2**40, k)]
    passage, parts = own(70), [own(20) for _ in range(10)]
    rows = [passage + own(40) for _ in range(800)]  # far from each other, with the same band keys
    for k in range(0, 200, 5):  # near copies that aren't linked to the smallest id of a band
        rows.append(rows[k][:-6] + own(6))
    rows += [sum((parts[j] for j in rng.permutation(10)[:5]), []) for _ in range(200)]  # no shingle of theirs is rare
    rows += [passage + rows[1000][:30] + own(4) for _ in range(60)]  # one component larger than a block
    order = rng.permutation(len(rows))
    rows = [(int(d), " ".join(rows[k])) for d, k in enumerate(order)]
    most = 45
    plain_step = neardup.across

    def bounded(percent):
        step = plain_step(percent)

        def work(key, members):
            assert members.num_rows <= most, f"{members.num_rows} rows in one group"
            return step(key, members)

        return work

    monkeypatch.setattr(neardup, "BLOCK", 10)
    monkeypatch.setattr(neardup, "across", bounded)
    want = linked(rows)
    got = plain(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert len(got) == len(rows) and len(set(want.values())) < len(rows) - 80
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 7), (20, 3), (3, 1)] + [(k, 500) for k in range(300, 500)]
    got = {r["node"]: r["component"] for r in plain(components(spark.createDataFrame(links, "a long, b long")))}
    assert got == {2: 1, 3: 1, 20: 1, 8: 7, 9: 7} | {k: 300 for k in range(301, 501)}


def test_checksum_of_very_many_links(spark):
    links = spark.range(17_500_000).selectExpr("id + 1 AS hi", "0L AS lo")  # a sum of 40-bit hashes overflows here
    assert _print(links)[0] == 17_500_000
    assert _print(links.filter("hi != 5")) != _print(links.filter("hi != 6"))


def window_hits(rows, items):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def cut(t):
        return tuple(pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))

    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            windows[w[a : a + k]].add(str(i))
    out = []
    for d, t in rows:
        w, found = cut(t), set()
        hit = [False] * len(w)
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if w[a : a + k] in windows:
                    found |= windows[w[a : a + k]]
                    hit[a : a + k] = [True] * k
        names = ",".join(sorted(found))
        out.append((d, len(w), sum(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), any(hit)))
    return Counter(out)


@pytest.mark.parametrize("shard", [2_000_000, 60])
def test_decontamination(spark, docs, awkward, empty, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    own = spark.createDataFrame([(1, "two words"), (2, "one"), (3, None), (4, "!!"), (5, BASE[:200]), (6, "tok3 tok4 tok5")], "item_id long, text string")
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for df, items in ((docs, bench), (awkward, own)):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        got = Counter(tuple(r[c] for c in columns) for r in plain(decontaminate.report(df, items)))
        assert got == window_hits(rows, [tuple(r) for r in items.collect()])
    assert decontaminate.report(empty, bench).count() == 0
    assert not decontaminate.report(awkward, own.limit(0)).filter("contaminated").count()
    left = plain(decontaminate.remove(awkward, own, coverage=1.0).filter("doc_id = 4"))
    assert left[0]["text"] == "" and decontaminate.remove(awkward, own).columns == awkward.columns


def test_sharding(spark, awkward, empty, docs, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_ROWS", 3)  # several cells in an arc
    many = spark.range(500).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "CAST(id AS string) AS text")
    for df, n in ((awkward, 5), (many, 24), (empty, 24), (docs, 24)):
        got = plain(sharding.shard_documents(df, shards=n))
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
            (r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in plain(df)
        )
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots.get(s, [])) for s in range(n)]
        assert max(counts) - min(counts) <= 1


def test_shards_follow_from_the_rows_alone(spark, monkeypatch):
    """Any partitioning, and both plans, give the same rows; a third of the rows are equal, another part shares its id only."""
    rows = spark.range(1800).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id % 40 ELSE id END AS doc_id", "IF(id % 3 = 0, 'same', CAST(id AS string)) AS text")
    seen = None
    for parts, cell in ((1, 100_000), (3, 100_000), (211, 100_000), (3, 1), (16, 50)):
        monkeypatch.setattr(sharding, "CELL_ROWS", cell)
        got = sorted(map(str, sharding.shard_documents(rows.repartition(parts), shards=24).collect()))
        seen = seen or got
        assert got == seen


def test_shards_equal_a_plain_ring(spark):
    """Rows by arc and shard are those that a ring in Python gives."""
    rows = spark.range(700).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    nodes = sharding.ring(9, 64)
    places, owners = [p for p, _ in nodes], [o for _, o in nodes]

    def arc(doc_id):
        place = zlib.crc32(hashlib.md5(str(doc_id).encode()).hexdigest().encode())
        return next((i for i, p in enumerate(places) if p >= place), 0)

    counts = Counter(arc(i) for i in range(700))
    dealt = sharding.deal([counts[a] for a in range(len(nodes))], owners, sharding.capacities(700, 9, 0.0))
    want = Counter({(a, s): hi - lo for a, lo, hi, s, _ in dealt})
    got = Counter((arc(r["doc_id"]), r["shard"]) for r in sharding.shard_documents(rows, shards=9).collect())
    assert got == want


def test_deal_follows_the_ring():
    owners, capacity, counts = [0, 1, 2, 0, 1], [3, 2, 4], [5, 0, 1, 2, 1]
    room, where, carried = list(capacity), {}, []
    for lap in range(2):
        for arc, owner in enumerate(owners):
            waiting = ([(arc, k) for k in range(counts[arc])] if not lap else []) + carried
            carried = []
            for key in waiting:
                if room[owner]:
                    room[owner] -= 1
                    where[key] = owner
                else:
                    carried.append(key)
    got = {(a, k): s for a, lo, hi, s, _ in sharding.deal(counts, owners, capacity) for k in range(lo, hi)}
    assert got == where and len(got) == sum(counts)


def test_mixing(spark, awkward, empty, docs):
    how = {"weights": (5, 2, 1), "share": 1.5}
    for df in (awkward, docs):
        got = plain(mixing.mix(df, **how))
        assert len(got) == df.count() and all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in got)
        assert sum({r["source_size"]: r["target"] for r in got}.values()) <= 1.5 * sum(r["size"] for r in got) + 1e-6
        assert got == plain(mixing.mix(df, **how))
    assert mixing.mix(empty, **how).count() == 0
    assert mixing.mixed(awkward, **how).columns == awkward.columns


@pytest.mark.parametrize("file_rows", [1_000_000, 40])
def test_mixing_parts_equal_rows(spark, docs, monkeypatch, file_rows):
    """Half of all rows is one row: every source still ends within a document of its target, as the SQL says."""
    import duckdb

    from weftline.llm.queries import ORACLES

    monkeypatch.setattr(mixing, "FILE_ROWS", file_rows)
    n = docs.count()
    clashing = docs.withColumn("size", F.lit(1)).withColumn("hash", F.lit("x")).withColumn("mix_rank", F.lit(3))
    one = clashing.filter("size(split(text, ' ')) between 300 and 900").orderBy("doc_id").limit(1).withColumn("k", F.explode(F.array_repeat(F.lit(1), n))).drop("k")
    rows = clashing.unionByName(one).repartition(7).cache()
    how = {"weights": (5, 2, 1), "share": 1.5}
    got = plain(mixing.mix(rows, **how))
    assert len(got) == 2 * n
    by, largest = defaultdict(int), defaultdict(int)
    for r in got:
        at = (r["source_size"], r["target"])
        by[at] += r["taken"]
        largest[at] = max(largest[at], r["size"])
    assert all(abs(v - at[1]) <= largest[at] for at, v in by.items())
    common = Counter(r["taken"] for r in got if r["doc_id"] == one.first()["doc_id"])
    assert len(common) > 1  # the edge fell among the equal rows
    con = duckdb.connect()
    con.register("documents", rows.select("doc_id", "text", "source").toPandas())
    want = con.execute(ORACLES["op8_hash_threshold_mix"]).fetchall()
    names = [c[0] for c in con.description]
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(want)
    full = mixing.mixed(rows, **how)
    assert full.columns == rows.columns
    assert Counter(r["doc_id"] for r in plain(full.select("doc_id"))) == +Counter(i for r in got if r["size"] for i in [r["doc_id"]] * (r["taken"] // r["size"]))


def test_warc(spark):
    big, page = "é\r\n\r\nWARC/1.1\r\n" * 100, "p" * 999
    rows = [(1, "u", big), (2, None, big), (3, "u v", big), (4, "u", page), (5, "u", page), (6, "u", None), (7, "u", ""), (None, "u", big), (3, "u", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, original long")
    got = Counter(tuple(r) for r in warc.deduplicate(pages).collect())
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == big and i != 3
        want[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)] += 1
    assert got == want
    assert warc.deduplicate(pages.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    big = "é" * 600
    rows = [(k, f"http://h/{k % 7}", f"{k}" * k if k % 3 else big) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    resolved = warc.resolve(pages)
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    warc.write_archives(resolved, one)
    warc.write_archives(resolved, many, file_bytes=1000)
    files = {p: sorted(f for f in os.listdir(p) if f.startswith("part-")) for p in (one, many)}
    assert len(files[one]) <= 2 < len(files[many])
    whole = [Counter(tuple(r) for r in warc.read_archives(spark, p).collect()) for p in (one, many)]
    assert whole[0] == whole[1] and sum(whole[0].values()) == 60 and all(r[-1] for r in whole[0])
    for f in files[many]:
        content = open(os.path.join(many, f), "rb").read()
        found = list(warc.parse(content))
        assert found and (len(found) == 1 or len(content) <= 1000)
        for headers, block in found:
            if headers["WARC-Type"] == "revisit":
                assert headers["WARC-Refers-To"].startswith("<urn:page:57:") and not block.partition(b"\r\n\r\n")[2]
                assert headers["WARC-Refers-To-Target-URI"] == "http://h/1"
                assert headers["WARC-Refers-To-Date"] == headers["WARC-Date"]
    # a changed byte of a payload is found by its digest, a cut file by its record end
    content = open(os.path.join(one, files[one][0]), "rb").read()
    headers, block = next((h, b) for h, b in warc.parse(content) if h["WARC-Type"] == "response" and len(b.partition(b"\r\n\r\n")[2]) > 20)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0").write_bytes(content.replace(block, block[:-1] + b"#", 1))
    assert sum(not r["whole"] for r in warc.read_archives(spark, str(tmp_path / "bad")).collect()) == 1
    with pytest.raises(ValueError):
        list(warc.parse(content[:-3]))


def base_counts(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, sum(hit), len(w) < 10 or 100 * sum(hit) > 20 * len(w)


def test_line_crf(spark, awkward, empty, labels, docs):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for df, known in ((awkward, labels), (docs, spark.read.parquet(f"{SF}/labels.parquet"))):
        got = plain(linecrf.apply_rules(df, known))
        assert Counter(tuple(r[c] for c in columns) for r in got) == Counter((r["doc_id"], *base_counts(r["text"])) for r in plain(df))
        assert not any(r["kept"] and r["base_failed"] for r in got)
    assert linecrf.apply_rules(empty, labels).count() == 0
    assert linecrf.apply_rules(awkward, labels.limit(0)).count() == len(AWKWARD)


def test_line_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    crf = linecrf.learn_from(docs, labels.filter(~held))
    rows = docs.join(labels.filter(held & F.col("quality").isNotNull()), "doc_id").orderBy("doc_id").select("text", "quality").collect()

    def judged(texts):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        cuts = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
        lines = linecrf.lines_of(data, cuts)
        return linecrf.judge(data, cuts, crf), linecrf.viterbi(crf.bins.score(lines.x, crf.emit), lines.first, crf), lines.words

    known = [(r["text"] or "", r["quality"]) for r in rows]
    out, _, _ = judged([t for t, _ in known])
    truth = np.array([q == 1 for _, q in known])
    assert (out["kept"] == truth).mean() > 0.96
    assert ((out["content_words"] > 0) & (out["content_words"] < out["n_words"])).mean() > 0.03
    # documents joined from a good and a bad one, in both orders: lines get the label of their half
    halves = zip([t for t, q in known if q == 1 and t], [t for t, q in known if q == 0 and t])
    right = total = 0
    for k, (good, bad) in enumerate(halves):
        parts = [(good, 1), (bad, 0)][:: 1 if k % 2 else -1]
        want = np.concatenate([np.full(t.count("\n") + 1, q) for t, q in parts])
        _, got, n = judged(["\n".join(t for t, _ in parts)])
        right, total = right + ((got == want) & (n > 0)).sum(), total + (n > 0).sum()
    assert total > 500 and right / total > 0.9


def test_best_share():
    share, good = np.array([0.0, 0.1, 0.4, 0.6, 0.9, 1.0]), np.array([0, 0, 0, 1, 1, 1], bool)
    assert linecrf.best_share(share, good) == 0.5
    assert linecrf.best_share(share, ~good) in (0.05, 0.95)  # any cut between two values; one right beyond none
    assert linecrf.best_share(np.ones(4), good[:4]) == linecrf.KEEP_SHARE
    rng = np.random.default_rng(3)
    for _ in range(50):
        share, good = rng.integers(0, 6, 12) / 5, rng.random(12) < 0.5
        cut = linecrf.best_share(share, good)
        values = np.unique(share)
        if len(values) > 1:
            assert ((share >= cut) == good).sum() == max(((share >= (a + b) / 2) == good).sum() for a, b in zip(values, values[1:]))


def test_crf_steps_match_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    crf = linecrf.Crf(None, np.zeros((0, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    first = np.array([0, 3, 3, 7, 8])
    score = rng.normal(size=(8, 2))
    marginal, pairs, _ = linecrf.expectations(score, first, crf)
    label = linecrf.viterbi(score, first, crf)
    for a, b in zip(first[:-1], first[1:]):
        if a == b:
            continue
        ways = list(itertools.product((0, 1), repeat=b - a))
        value = [crf.start[w[0]] + sum(score[a + k, s] for k, s in enumerate(w)) + sum(crf.step[x, y] for x, y in zip(w, w[1:])) for w in ways]
        p = np.exp(value) / np.exp(value).sum()
        assert tuple(label[a:b]) == ways[int(np.argmax(value))]
        for k in range(b - a):
            assert abs(sum(q for q, w in zip(p, ways) if w[k]) - marginal[a + k, 1]) < 1e-9
    assert abs(pairs.sum() - 5) < 1e-9


@pytest.mark.parametrize("operator,label,of,part", [(toxicity, "toxic", 3, 1), (pu, "quality", 5, 0)])
def test_scores(spark, awkward, empty, labels, operator, label, of, part):
    for known in (labels, labels.limit(0)):
        got = plain(operator.score_documents(awkward, known))
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
        for r in got:
            assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % of == part)
    assert operator.score_documents(empty, labels).count() == 0
    # held-out rows of a larger table: better than always naming the larger class
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = operator.score_documents(docs, known).filter("held_out").join(known, "doc_id").select(label, "predicted").collect()
    assert sum(a == b for a, b in got) / len(got) > 0.95
    # labels of held-out rows don't matter
    twisted = known.selectExpr("doc_id", f"IF(crc32(CAST(CAST(doc_id AS string) AS binary)) % {of} = {part}, 1 - {label}, {label}) AS {label}")
    few = docs.limit(50)
    assert plain(operator.score_documents(few, known).orderBy("doc_id")) == plain(operator.score_documents(few, twisted).orderBy("doc_id"))


def test_pu_needs_no_negatives(spark):
    docs, known = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    share = known.agg(F.avg("quality")).first()[0]
    got = pu.score_documents(docs, known.filter("quality = 1")).filter("held_out").join(known, "doc_id").select("quality", "predicted", "prior").collect()
    assert sum(a == b for a, b, _ in got) / len(got) > 0.95
    assert abs(got[0]["prior"] - share) < 0.05
    # one text for each id, whatever repeats; the answer is that of the table without repeats
    few = docs.limit(300).cache()
    again = few.unionByName(few.limit(1).withColumn("copy", F.explode(F.array_repeat(F.lit(1), 500))).drop("copy"))
    one, two = (plain(pu.score_documents(d, known).dropDuplicates().orderBy("doc_id")) for d in (few, again))
    assert one == two


def test_pu_slopes_follow_the_risk():
    rng = np.random.default_rng(5)

    def loss(z):
        return np.log(1 + np.exp(-z))

    for prior, shift in ((0.3, 0.0), (0.9, -4.0)):
        gp, gu = rng.normal(size=9), rng.normal(size=7) + shift
        hidden = loss(-gu).mean() - prior * loss(-gp).mean()
        assert (hidden >= 0) == (prior == 0.3)

        def risk(p, u):
            rest = loss(-u).mean() - prior * loss(-p).mean()
            return prior * loss(p).mean() + rest if hidden >= 0 else -rest

        want_p = [(risk(gp + h, gu) - risk(gp - h, gu)) / 2e-6 for h in np.eye(9) * 1e-6]
        want_u = [(risk(gp, gu + h) - risk(gp, gu - h)) / 2e-6 for h in np.eye(7) * 1e-6]
        rp, ru = pu.slopes(gp, gu, prior)
        assert np.allclose(rp, want_p, atol=1e-6) and np.allclose(ru, want_u, atol=1e-6)


@pytest.mark.parametrize("share", [0.2, 0.5, 0.85])
def test_prior_of_a_planted_mixture(share):
    rng = np.random.default_rng(6)
    good, bad = rng.normal(1.5, 1, (9000, pu.WIDTH)), rng.normal(-1.5, 1, (4000, pu.WIDTH))
    n = int(4000 * share)
    assert abs(pu.estimate_prior(good[:4000], np.concatenate((good[4000 : 4000 + n], bad[: 4000 - n]))[rng.permutation(4000)]) - share) < 0.03


def folded_table(spark, rows):
    return spark.createDataFrame(sorted({(y, toxicity.fold(t)) for t, y in rows}), "label int, folded string").repartition(3)


def test_folding():
    for text in ("You IDIOT", "you \u0456di\u043et", "you 1d10t", "yo\u200bu id\u0301iot!", "you \uff49\uff44\uff49\uff4f\uff54", "you  \U0001d422\U0001d41dio\u00adt"):
        assert toxicity.fold(text) == " you idiot "
    assert toxicity.fold("\ufb01n") == " fin " and toxicity.fold(None) == toxicity.fold("") == "  "


def test_lexicon_matches_plain_scan():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("ab"), rng.integers(1, 6))) for _ in range(40)]
    weights = {(f" {w}" if k % 2 else f" {w} "): float(k % 7 + 1) for k, w in enumerate(sorted(set(words))[::2]) if len(w) > 1}
    lexicon = toxicity.Lexicon(weights)
    for _ in range(200):
        text = toxicity.fold(" ".join(rng.choice(words, rng.integers(0, 12))))
        want = {}
        for at in range(len(text)):
            hits = [w for e, w in weights.items() if text.startswith(e, at)]
            if hits:
                want[at] = max(hits)
        assert toxicity.matched(lexicon.automaton(), text) == want
        total, n = toxicity.sums(text, lexicon.automaton(), frozenset())
        assert total == sum(want.values()) and n == len(text.split())


def test_lexicon_counts_match_plain_ones(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.learn_from(docs, labels, label="toxic", learns=F.lit(True))
    rows = {(r["toxic"], toxicity.fold(r["text"])) for r in docs.join(labels, "doc_id").collect()}
    sides = [[t for y, t in rows if y], [t for y, t in rows if not y]]
    a, b = (Counter(g for t in side for g in toxicity._entries(t)) for side in sides)
    n, m = map(len, sides)
    want = toxicity.choose([(g, c, b[g]) for g, c in a.items() if c >= max(3, n // 200)], n, m)
    assert want and lexicon.weights == want
    machine = toxicity.Lexicon(want).automaton()
    around = [Counter(p for t in side for p in {p for at in toxicity.matched(machine, t) for p in toxicity.phrases(t, at) if p}) for side in sides]
    assert lexicon.exceptions == {p for p, c in around[1].items() if c >= 5 and not around[0][p]}



def test_lexicon_folds_and_excepts(spark):
    bad = [(f"you {w} number {k}", 1) for k in range(30) for w in ("gr0mble", "grоmble", "GROMBLE")]
    fine = [(f"a quiet gromble stone stands {k}", 0) for k in range(40)] + [(f"plain words {k}", 0) for k in range(200)]
    lexicon = toxicity.learn(folded_table(spark, bad + fine))
    machine = lexicon.automaton()
    s = {t: float(toxicity.score(lexicon, *[__import__("numpy").array([float(x)]) for x in toxicity.sums(toxicity.fold(t), machine, lexicon.exceptions)])[0]) for t in ("you gr0mble", "a quiet gromble stone", "")}
    assert s["you gr0mble"] > 0.7 > s["a quiet gromble stone"] and s[""] < 0.5


@pytest.mark.parametrize("operator", [neardup.near_duplicates, substrings.remove_repeats, suffixarray.remove_repeats])
def test_empty_tables(empty, operator):
    out = operator(empty)
    assert "doc_id" in out.columns and out.count() == 0


def test_pipeline(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        stage = step(spark, stage, SF)
        assert stage.columns == docs.columns, name
    rows = plain(stage)
    # plain version of the last stages' inputs and of the whole
    kept = plain(corpus_pipeline.toxic(spark, docs, SF))
    tops = linked([(r["doc_id"], r["text"]) for r in kept])
    alone = [r for r in kept if tops[r["doc_id"]] == r["doc_id"]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in window_hits([(r["doc_id"], r["text"]) for r in alone], items) if not x[5]}
    mix = plain(mixing.mix(docs.filter(docs.doc_id.isin(list(clean))), **corpus_pipeline.MIX))
    want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mix if r["size"]})
    sized = {r["doc_id"] for r in mix if r["size"]}
    assert +want == Counter(r["doc_id"] for r in rows if r["doc_id"] in sized)
    assert Counter(r["doc_id"] for r in plain(out)) == Counter(r["doc_id"] for r in rows)
