"""Groups of near copies against all pairs."""

import random
import re

import numpy as np
import pytest

from rollcall.llm import components, jaccard


def plain(rows, percent, size):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed, n, words=60, edits=3):
    """Chains of copies of copies, so that groups hold pairs that are not linked themselves."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.7:
            w = rng.choice(texts[-6:]).split()
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.randint(3, words))]
        texts.append(" ".join(w))
    return list(enumerate(texts))


CASES = [
    (5, None), (6, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (10, "one two"), (11, "one two three"), (4, "one two three"), (12, "one two three "),
    (13, "a b " * 50), (14, "a b " * 70), (None, "one two three"), (None, "alone again here now"), (15, "x y z q"), (15, "other words in it"),
    (16, "x y z q"), (3, "other words in it"), (3, "other words in it"),
]


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_cases(docs, clashing):
    assert collected(jaccard.groups(clashing(docs(*CASES)))) == plain(CASES, 90, 3)


@pytest.mark.parametrize("percent, size", [(90, 3), (60, 2)])
def test_near_copies_against_all_pairs(docs, percent, size):
    rows = near_copies(percent, 150)
    want = plain(rows, percent, size)
    assert len({c for _, _, c in want}) < 140
    assert collected(jaccard.groups(docs(*rows), percent, size)) == want


@pytest.mark.parametrize("twos", [0, 1, 3, 99])
def test_whatever_the_allotments_no_pair_is_lost(docs, twos):
    """The pigeonhole principle finds all links, with one-deletion neighbourhoods or without."""

    def allot(differ, size):
        some = min(twos, (differ + 3) // 2)
        return differ + 3 - some, some

    rows = near_copies(11, 120, words=40, edits=4)
    assert collected(jaccard.groups(docs(*rows), 50, 2, allot=allot)) == plain(rows, 50, 2)


def test_a_family_in_several_chunks(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 6)
    monkeypatch.setattr(jaccard, "TILE_SETS", 2)
    monkeypatch.setattr(jaccard, "CHUNK_SKETCHES", 5)
    monkeypatch.setattr(jaccard, "STRIP", 2)
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rows = near_copies(3, 120, words=50, edits=3)
    assert collected(jaccard.groups(docs(*rows), 70, 2)) == plain(rows, 70, 2)


def test_allotments_sum_to_what_the_pigeonhole_needs():
    chosen = {(h, n): jaccard.allotment(h, n) for h, n in ((1, 10), (2, 20), (3, 30), (18, 170), (105, 1000))}
    assert all(segments + twos > h and twos <= segments for (h, _), (segments, twos) in chosen.items())
    assert chosen[1, 10][1] > 0 and chosen[105, 1000][1] == 0


@pytest.mark.parametrize("percent, twos, agree", [(90, 0, 4), (80, 0, 4), (60, 0, 4), (60, 2, 4), (50, 0, 2), (80, 99, 1), (70, 1, 1), (80, None, None), (60, None, None)])
def test_every_pair_over_the_threshold_shares_a_signature(percent, twos, agree):
    """The promise that the rest relies on, with small sets, where most segments are empty."""
    rng = np.random.default_rng(percent)

    def allot(differ, size):
        if twos is None:
            return jaccard.allotment(differ, size)
        some = min(twos, (differ + agree) // 2)
        return differ + agree - some, some

    bands = jaccard.Bands(percent, 1000, allot)
    met = 0
    for _ in range(1500):
        n = int(rng.integers(1, 40))
        base = rng.integers(0, 1 << 60, n + 12).astype(np.uint64)
        a, b = base[:n], np.concatenate((base[int(rng.integers(0, 1 + n // 4)) : n], base[n : n + int(rng.integers(0, 1 + n // 4))]))
        x, y = set(a.tolist()), set(b.tolist())
        if x == y or not y or 100 * len(x & y) < percent * len(x | y):
            continue
        met += 1
        row, _, values = jaccard.signatures(np.concatenate((a, b)), np.array([len(a), len(a) + len(b)]), bands)
        assert set(values[row == 0].tolist()) & set(values[row == 1].tolist())
    assert met > 100


def test_matrix_products_count_common_elements():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(-(1 << 62), 1 << 62, 5).repeat(1)) for _ in range(3)]
    sets += [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[:20]] for a in sets]
    assert (jaccard._common(sets, sets[:20]) == np.array(want)).all()


def test_tiles_cover_all_sets_once():
    sizes = np.array([3, 600_000, 1, 1] + [100] * 1500 + [250_000, 250_001])
    cut = jaccard.tiles(sizes)
    assert [k for t in cut for k in range(t.start, t.stop)] == list(range(len(sizes)))
    assert all(t.stop - t.start <= 512 and (t.stop - t.start == 1 or sizes[t].sum() <= 250_000) for t in cut)
    assert jaccard.tiles(sizes[:0]) == []


@pytest.mark.parametrize("share", [0.0, 0.02, 0.1, 1.0])
@pytest.mark.parametrize("own", [True, False])
def test_spanning_links_connect_what_the_linked_pairs_connect(share, own):
    rng = np.random.default_rng(7)
    linked = rng.random((40, 40 if own else 25)) < share
    a = list(range(40))
    b = a if own else list(range(100, 125))

    def parts(pairs):
        of = {x: {x} for x in (*a, *b)}
        for x, y in pairs:
            if of[x] is not of[y]:
                both = of[x] | of[y]
                of.update({z: both for z in both})
        return {frozenset(p) for p in of.values()}

    found = jaccard.spanning(a, b, linked)
    assert parts(found) == parts((a[i], b[j]) for i, j in zip(*np.nonzero(linked)))
    assert len(found) <= len(a) + len(b) and all(x != y for x, y in found)


def test_bands_cover_all_sizes_and_differences():
    for percent in (50, 80, 90):
        bands = jaccard.Bands(percent, 3000)
        for a in range(1, 1500):
            b = np.arange(a, a * 100 // percent + 1)
            assert (bands.of(b) - bands.of(np.array([a]))[0] <= 1).all()
            # The fewest common elements that reach the threshold, and what that leaves on either side.
            common = -(-percent * (a + b) // (100 + percent))
            assert ((a + b) - 2 * common <= bands.differ[bands.of(np.array([a]))[0]]).all()


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    ids = rng.sample(range(1000), 120)
    links = [(a, b) for a, b in zip(ids[:100], ids[1:100])] + [(ids[110], ids[111]), (ids[111], ids[110]), (ids[112], ids[112])]
    rng.shuffle(links)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: min(ids[:100]) for i in ids[:100]} | {i: min(ids[110:112]) for i in ids[110:112]}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_document_of_each_group_stays(docs):
    d = docs((3, "same words here again"), (1, "same words here again"), (2, "others are kept as well"), (4, None), (None, "same words here again"))
    kept = jaccard.without_copies(d)
    assert kept.columns == d.columns
    # One document of each group: the copy without an id goes too, the empty text stays.
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [1, 2, 4]


def test_empty_table(docs):
    assert jaccard.groups(docs((1, "x")).where("false")).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(docs, clashing):
    text = "one two three four five six seven eight nine ten eleven twelve"
    near, other = text + " thirteen", "quite another text that has nothing at all to do with it"
    rows = [(5, text), (5, other), (3, near), (3, near), (3, near), (None, text), (None, "alone " * 9), (9, None), (9, ""), (9, None)]
    table = clashing(docs(*rows))
    left = jaccard.without_copies(table, percent=80, size=5)
    assert left.columns == table.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(5, other), (3, near), (None, "alone " * 9), (9, None), (9, ""), (9, None)], key=repr)


def test_sets_go_to_python_in_small_batches(spark, monkeypatch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, write = spark.conf.get(key), {}, jaccard.stored
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None)], "doc_id long, text string")

    def noted(df, name):
        seen[name] = int(spark.conf.get(key))
        return write(df, name)

    monkeypatch.setattr(jaccard, "stored", noted)
    got = {(r.doc_id, r.component_id) for r in jaccard.groups(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}
    assert {"index", "sketches", "components"} <= set(seen) and set(seen.values()) == {jaccard.BATCH_ROWS}
    assert spark.conf.get(key) == before


def test_workers_hand_free_memory_back():
    import ctypes
    import re

    def held():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read()).group(1)) / 1024

    if not getattr(ctypes.CDLL(None), "malloc_trim", None):
        pytest.skip("not glibc")

    def run(batches):
        for b in batches:
            rows = [bytes(3000) for _ in range(60_000)]
            kept.append(bytes(100))  # above what is freed
            yield b
            del rows

    kept = []
    list(jaccard.lean(run)(iter([1])))
    before = held()
    assert list(jaccard.lean(run)(iter([1, 2]))) == [1, 2]
    assert held() < before + 60
