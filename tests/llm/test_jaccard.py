"""Near-duplicates at a similarity against all pairs, and the pipeline's stage against the same."""

import os
import random

import pytest

from logspark.llm import jaccard, simhash

SF = "/root/testdata/sf0.01"


def brute(rows):
    """The (doc_id, text) that stay of each group."""
    rows = sorted({(i is None, i or 0, t or "") for i, t in rows})
    sets, root = [], list(range(len(rows)))
    for _, _, t in rows:
        w = t.encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return sorted((rows[i][1] if not rows[i][0] else None, rows[i][2]) for i in range(len(rows)) if find(i) == i)


def near_copies(rng):
    words = [f"w{i}" for i in range(500)]
    rows = []
    for k in range(60):
        text = rng.choices(words, k=rng.randint(30, 300))
        rows.append((10 * k, " ".join(text)))
        for j in range(1, 5):
            copy = list(text)
            for _ in range(j * len(text) // 120 + 1):
                copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 * k + j, " ".join(copy)))
    return rows


def test_one_of_each(spark):
    rows = near_copies(random.Random(5)) + [(9000, None), (9001, ""), (9002, "one"), (9003, "ONE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text or "") for r in jaccard.one_of_each(df).collect())
    assert got == brute(rows)
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_hot_buckets_lose_no_pair(spark):
    rng = random.Random(9)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # close copies, and a chain of them that drifts away
        copy = list(text)
        copy[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    for i in range(60):
        text[i] = f"y{i}"
        rows.append((1000 + i, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (300, 3000):
        assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(df, hot=hot).collect()) == brute(rows)


def test_chunks_meet_in_bounded_buckets(spark):
    rows = [(n, 9, cell) for cell in (1, 2) for n in range(400)] + [(n, 9, 3) for n in range(20)]
    dealt = spark.createDataFrame(rows, "node long, size long, cell long")
    cells = {}
    for r in jaccard._routes(dealt, 1000).collect():
        cells.setdefault(r.cell, set()).add(r.node)
    met = {(a, b) for own in cells.values() for a in own for b in own if a < b}
    assert met == {(a, b) for b in range(400) for a in range(b)}
    assert max(map(len, cells.values())) <= 130  # about 100 hashes of 10 each
    assert set(range(20)) in cells.values()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.near_dedup_stage(spark, docs, SF)
    assert out.columns == docs.columns
    want = [i for i, _ in brute([(r.doc_id, r.text) for r in docs.collect()])]
    assert sorted(r.doc_id for r in out.collect()) == want


def test_rows_are_known_by_id_and_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    # A whole repeat; a row that shares a kept id but copies another; a null id's copy of a kept text; a null id alone.
    rows = [(1, a), (1, a), (2, b), (2, a), (None, a), (None, c), (None, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in jaccard.one_of_each(df).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, a), (2, b), (None, c)]


def test_fingerprints_link_what_min_hashes_miss(spark, monkeypatch):
    """Without any shared min-hash key, near copies within three bits are still found, by the SimHash join alone."""
    rng = random.Random(3)
    rows = []
    for k in range(40):
        text = rng.choices([f"w{i}" for i in range(500)], k=400)
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join([*text[:-1], "changed"]))]
    sets = {i: jaccard.grams(t) for i, t in rows}
    bits = {i: simhash.majority(s) for i, s in sets.items()}
    near = {(i, i + 1) for i in range(0, 400, 10) if (bits[i] ^ bits[i + 1]).bit_count() <= 3}
    assert len(near) > 30
    real, routes = jaccard._fingerprint_cells, jaccard._routes
    # Only the cells of fingerprints reach the buckets.
    monkeypatch.setattr(jaccard, "_routes", lambda dealt, hot: routes(dealt.join(seen[0], ["node", "cell"], "left_semi"), hot))
    seen = []

    def cells(classes):
        seen.append(real(classes).select("node", "cell"))
        return real(classes)

    monkeypatch.setattr(jaccard, "_fingerprint_cells", cells)
    kept = {r.doc_id for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert {i for i, _ in rows} - kept == {b for _, b in near}
