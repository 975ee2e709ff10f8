"""MinHash, suffix, chained and lattice duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from odd import lower, prose
from orrery.llm import chains, lattice, minhash, suffix
from orrery.llm.components import components
from orrery.llm.scratch import Scratch


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), g, g == i) for i, g in groups(sets, links).items()}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 120), (110, 120), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 110: 100, 120: 100}


def test_minhash_odd_rows(odd, odd_rows, empty):
    got = {r.doc_id: tuple(r)[1:] for r in minhash.near_duplicates(odd).collect()}
    assert got == brute(odd_rows)
    assert minhash.near_duplicates(empty).count() == 0
    twice = minhash.near_duplicates(odd.union(odd)).collect()
    assert len(twice) == 2 * len(odd_rows) and {tuple(r) for r in twice} == {(k, *v) for k, v in brute(odd_rows).items()}


def test_minhash_dense_group(spark):
    """Hundreds of texts, many alike in part: members that the first hubs miss are linked later."""
    r, base, rows = random.Random(8), prose(7, 100).split(), []
    for i in range(300):
        w = base.copy()
        for _ in range(r.randrange(0, 8)):
            w[r.randrange(100)] = f"z{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: v[1] for i, v in brute(rows).items()}


def removed(rows, depth=400):
    texts = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + depth] for b in texts.values() for k in range(len(b) - depth + 1))
    out = {}
    for i, b in texts.items():
        cover = np.zeros(len(b) + 1, int)
        for k in range(len(b) - depth + 1):
            if seen[b[k : k + depth]] > 1:
                cover[k] += 1
                cover[k + depth] -= 1
        gone = np.cumsum(cover[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(rows, passage=51):
    """Documents with a string of ``passage`` words that another document has."""
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in rows}
    where = {}
    for i, w in words.items():
        for k in range(len(w) - passage + 1):
            where.setdefault(tuple(w[k : k + passage]), set()).add(i)
    return {i for own in where.values() if len(own) > 1 for i in own}


def first_kept(rows, depth=400):
    """Maximal byte ranges of strings that occurred before, by (id, place)."""
    seen, out = set(), set()
    for i, t in sorted(rows):
        b = (t or "").encode()
        again = np.zeros(len(b) + 1, int)
        for k in range(len(b) - depth + 1):
            if b[k : k + depth] in seen:
                again[k] += 1
                again[k + depth] -= 1
            seen.add(b[k : k + depth])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(again[:-1]) > 0, [0]])))
        out |= {(i, a, e) for a, e in edge.reshape(-1, 2).tolist()}
    return out


def check_suffix(df, rows, **options):
    assert {r.doc_id: tuple(r)[1:5] for r in suffix.without_repeats(df, **options).collect()} == removed(rows)
    assert {(r.id, r.s, r.e) for r in suffix.later_copies(df, **options).collect()} == first_kept(rows)
    assert {r.doc_id for r in suffix.sharing_passages(df, **options).collect()} == repeated_words(rows)


def test_suffix_odd_rows(odd, odd_rows, empty):
    check_suffix(odd, odd_rows)
    assert suffix.without_repeats(empty).count() == 0 and suffix.later_copies(empty).count() == 0 and suffix.sharing_passages(empty).count() == 0


def test_suffix_repeated_rows(spark, odd, odd_rows):
    twice = {r.doc_id: tuple(r)[1:5] for r in suffix.without_repeats(odd.union(odd)).collect()}
    whole = {i: (len((t or "").encode()),) for i, t in odd_rows}
    for i, (size,) in whole.items():
        assert twice[i][:3] == ((size, size, 1) if size >= 400 else (size, 0, 0))
    assert suffix.without_repeats(odd.union(odd)).count() == 2 * len(odd_rows)
    rows = [(None, prose(1, 200)), (None, prose(1, 200)), (3, prose(1, 200)), (3, prose(2, 90)), (4, prose(2, 90))]
    got = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got)[:2] == [(0, 0), (0, 0)] and len(got) == 5
    assert [r.n_removed for r in got if r.doc_id == 4] == [len(prose(2, 90)) if len(prose(2, 90)) >= 400 else 0]


@pytest.mark.parametrize("kinds", [8192, 3])
def test_suffix_common_passage(spark, kinds):
    """One passage in many texts, with different surroundings, more kinds than a bucket may hold, and strings repeated inside a text."""
    passage, r = prose(9, 150), random.Random(2)
    rows = [(i, f"{prose(100 + i, 60 + i)} {passage[r.randrange(40) : r.randrange(600, 800)]} {prose(200 + i, 50)}") for i in range(30)]
    rows += [(40 + i, f"{prose(300 + i, 20)}{'ab' * (199 + i)}{prose(400 + i, 20)}") for i in range(4)]
    rows += [(50, f"{prose(9, 90)} x {prose(9, 90)}"), (51, " ".join(["lorem ipsum"] * 90)), (52, " ".join(prose(9, 150).split()[20:71])), (53, " ".join(prose(9, 150).split()[20:70]))]
    check_suffix(spark.createDataFrame(rows, "doc_id long, text string"), rows, kinds=kinds)


def test_factors():
    """Earlier and later matches against the definition, from ranks of strings of three."""
    for text in (b"", b"ab", b"aaaaaa", b"abracadabra", b"mississippi", bytes(random.Random(3).choices(b"ab", k=60))):
        strings = [text[i : i + 3] for i in range(len(text) - 2)]
        earlier, later = suffix.factors(np.unique(strings, return_inverse=True)[1] if strings else np.zeros(0, np.int64))
        for i, s in enumerate(strings):
            assert earlier[i] == max((j for j in range(i) if strings[j] == s), default=-1)
            assert later[i] == min((j for j in range(i + 1, len(strings)) if strings[j] == s), default=-1)


def test_ranks_of_flanks():
    r = np.random.default_rng(4)
    bucket, left, right = np.sort(r.integers(0, 3, 40)), r.integers(0, 2, (40, 3)).astype(np.uint8), r.integers(0, 2, (40, 3)).astype(np.uint8)
    rank = suffix.ranks(bucket, left, right)
    keys = [(b, o, bytes(x[o:]), bytes(y[:o])) for b, x, y in zip(bucket, left, right, strict=True) for o in range(4)]
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            assert (rank.ravel()[i] == rank.ravel()[j]) == (a == b)


def test_chains_find_fuzzy_passages(spark):
    passage = prose(11, 80).split()
    fuzzy = passage.copy()
    fuzzy[20], fuzzy[45] = "other", "words"
    del fuzzy[60]
    rows = [(1, " ".join([prose(12, 40), *passage, prose(13, 30)])), (2, " ".join([prose(14, 10), *fuzzy, prose(15, 60)])), (3, prose(16, 200)), (4, None), (5, ""), (6, " ".join(passage))]
    got = chains.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} <= {frozenset(p) for p in ((1, 2), (1, 6), (2, 6))} and len(got) >= 2
    assert {i for r in got for i in (r.doc_id, r.partner_id)} == {1, 2, 6}
    for r in got:
        assert r.end - r.start >= 75 and r.n_equal >= 75


def edited(r: random.Random, words: list[str], rate: float, other: list[str]) -> list[str]:
    out = words.copy()
    for k in r.sample(range(len(out)), round(rate * len(out))):
        out[k] = r.choice(other)
    return out


@pytest.mark.parametrize(("sharers", "size", "rate", "recall"), [(2, 40, 0.1, 0.9), (2, 60, 0.1, 0.98), (2, 40, 0.05, 0.98), (10, 40, 0.1, 0.98), (60, 40, 0.1, 0.95)])
def test_chains_find_edited_passages(spark, sharers, size, rate, recall):
    """Of documents with a partner whose passage agrees in the operator's own identity, nearly all stand in a row."""
    r, rows, real = random.Random(31), [], set()
    other = prose(77, 400).split()
    for g in range(240 // sharers):
        passage = prose(100 + g, size).split()
        copies = [edited(r, passage, rate, other) for _ in range(sharers)]
        for k, own in enumerate(copies):
            i = g * sharers + k
            rows.append((i, " ".join([prose(1000 + i, 50), *own, prose(5000 + i, 40)])))
            if any(sum(a == b for a, b in zip(own, c, strict=True)) >= chains.IDENTITY * size for j, c in enumerate(copies) if j != k):
                real.add(i)
    got = chains.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {i for x in got for i in (x.doc_id, x.partner_id)}
    assert len(real & found) >= recall * len(real) > 100
    assert all(min(x.end - x.start, x.p_end - x.p_start) >= chains.LEAST and x.n_equal >= chains.IDENTITY * max(x.end - x.start, x.p_end - x.p_start) for x in got)


def test_chains_of_two_passages_with_a_stretch_of_their_own_between(spark):
    first, second = prose(21, 40), prose(22, 40)
    rows = [(i, f"{prose(30 + i, 20)} {first} {prose(40 + i, 60)} {second} {prose(50 + i, 20)}") for i in range(2)]
    got = chains.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 2 and sorted(x.start // 50 for x in got) == [0, 2]


def test_screen_of_single_seeds_keeps_what_can_be_a_passage():
    """Pairs of passages with the changes that are allowed, one word more or less among them, all pass; other words seldom do."""
    r = np.random.default_rng(8)
    word = lambda n: r.integers(0, 1 << 62, n).astype(np.uint64)
    bits = lambda w, at: chains.around(w, np.array([at]), np.zeros(1, np.int64), np.array([len(w)]))
    passed = 0
    for _ in range(600):
        passage, at = word(30), int(r.integers(0, 30 - chains.SEED + 1))
        free = [k for k in range(30) if not at <= k < at + chains.SEED]
        x = passage.copy()
        x[r.choice(free, 6, replace=False)] = word(6)
        a, b = ([word(20), p, word(20)] for p in (passage, x))
        one, two = np.concatenate(a), np.concatenate(b)
        assert chains.hopeful(bits(one, 20 + at), bits(two, 20 + at))[0]
        cut = int(r.choice([k for k in free if abs(k - at) > 5]))
        less = np.concatenate([word(20), np.delete(passage, cut), word(20)])
        assert chains.hopeful(bits(one, 20 + at), bits(less, 20 + at - (cut < at)))[0]
        passed += chains.hopeful(bits(one, 20 + at), bits(np.concatenate([word(20 + at), passage[at : at + chains.SEED], word(40)]), 20 + at))[0]
    assert passed < 150
    ids = np.array([0, 1, -1, 2**63 - 1, -(2**63), 12345])
    assert (chains._ids(chains._ranks(ids)) == ids).all()


def test_chains_odd_rows(odd, empty):
    got = chains.passages(odd).collect()
    assert {i for r in got for i in (r.doc_id, r.partner_id)} == {0, 1, 2, 3, 4, 11, 12}
    assert chains.passages(empty).count() == 0


def test_chains_against_all_predecessors():
    """The tree's scores against trying every match before each, and chains that are disjoint and increase."""
    r, k = random.Random(12), chains.SEED
    for n in (1, 2, 5, 30, 80):
        for _ in range(12):
            matches = sorted({(x, x + r.choice([0, 0, 0, 3, -4, 60]) if r.random() < 0.7 else r.randrange(120)) for x in (r.randrange(120) for _ in range(n))})
            best = []
            for i, (x, y) in enumerate(matches):
                own = float(k)
                for j, (px, py) in enumerate(matches[:i]):
                    if px + k <= x and py + k <= y:
                        own = max(own, k + best[j] - 0.06 * (x - px - k + y - py - k))
                    elif 0 < x - px == y - py < k:
                        own = max(own, best[j] + x - px)
                best.append(own)
            assert chains.scores(matches)[0] == pytest.approx(best)
            found = chains.chain(matches)
            assert sorted(m for c in found for m in c) == matches
            assert all(p[0] < q[0] and p[1] < q[1] for c in found for p, q in zip(c, c[1:], strict=False))
    tree = chains.Fenwick(8)
    for place, value in ((3, 5.0), (1, 7.0), (6, 6.0)):
        tree.raise_to(place, value, place)
    assert tree.prefix(1) == (0.0, -1) and tree.prefix(4) == (7.0, 1) and tree.prefix(8) == (7.0, 1)


def test_chains_find_every_exact_passage_of_the_least_length(spark):
    """Passages of thirty words, that may have one seed alone, each in two documents of its own."""
    rows = []
    for i in range(150):
        passage = prose(1000 + i, 30)
        rows += [(2 * i, f"{prose(2000 + i, 25)} {passage} {prose(3000 + i, 25)}"), (2 * i + 1, f"{prose(4000 + i, 40)} {passage} {prose(5000 + i, 9)}")]
    got = chains.passages(spark.createDataFrame(rows + rows[:20], "doc_id long, text string")).collect()
    assert {frozenset((r.doc_id, r.partner_id)) for r in got} == {frozenset((2 * i, 2 * i + 1)) for i in range(150)}
    for r in got:
        assert r.end - r.start >= 30 and r.n_equal >= 30


def vectors():
    r = np.random.default_rng(5)
    x = r.standard_normal((60, 64)).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    for i in range(40):  # a dense group, some at the edge of the threshold
        rows.append((100 + i, (x[0] + r.standard_normal(64) * (0.02 + 0.15 * (i % 2))).astype(np.float32).tolist(), 0))
    rows += [(200, rows[3][1], 0), (201, rows[3][1], 1), (202, rows[3][1], None), (203, None, 0), (204, [], 0), (205, [0.0] * 64, 0), (206, [None] + [1.0] * 63, 0), (207, [float("nan")] * 64, 0), (208, [float("inf")] * 64, 0), (209, [2 * v for v in rows[3][1]], 0), (210, [1.0, 2.0], 0), (211, [1.0, 2.01], 0)]
    return rows


def test_lattice(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "vec_id as id", "1 as w", "'v' as v")
    def good(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def cos(a, b):
        a, b = np.float32(a).astype(float), np.float32(b).astype(float)
        return a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)

    links = [(i, j) for i, v, k in rows for j, w, m in rows if i < j and k is not None and k == m and good(v) and good(w) and len(v) == len(w) and cos(v, w) >= 0.98]
    n = Counter(x for p in links for x in p)
    want = {i: (n[i], g, g == i) for i, g in groups([r[0] for r in rows], links).items()}
    assert {r.vec_id: tuple(r)[1:] for r in lattice.near_vectors(df).collect()} == want
    assert lattice.near_vectors(df.where("false")).count() == 0
    # Ids that repeat, with the same vector and with another one.
    twice = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in lattice.near_vectors(twice).collect()) == [(1, 0, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


@pytest.mark.parametrize("chance", [20, 5])
def test_lattice_links_with_keys_of_several_rotations(spark, monkeypatch, chance):
    """Pairs just above the threshold are found as well where labels are so large that keys join two or three rotations."""
    monkeypatch.setattr(lattice, "CHANCE", chance)
    r = np.random.default_rng(9)
    x, e = r.standard_normal((2, 500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e -= (e * x).sum(axis=1, keepdims=True) * x
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    y = 0.9801 * x + np.sqrt(1 - 0.9801**2) * e
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]
    got = lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {g.vec_id: (g.n_links, g.component_id) for g in got} == {i: (1, i % 500) for i in range(1000)}


def test_lattice_decoding():
    minimal = lattice.roots()
    assert minimal.shape == (240, 8) and np.allclose((minimal**2).sum(axis=1), 2)
    x = np.random.default_rng(2).standard_normal((200, 8))
    near = lattice.decode(x)
    own = ((x - near) ** 2).sum(axis=1)
    assert own.max() <= 1 + 1e-9
    for root in minimal:  # no neighbouring lattice point is nearer
        assert (((x - near - root) ** 2).sum(axis=1) >= own - 1e-9).all()


def test_minhash_templates_below_the_threshold(spark):
    """Texts of one template, mostly just below the threshold: what no hub links is compared all the same."""
    r, base, rows = random.Random(4), prose(21, 200).split(), []
    for i in range(1500):
        w = base.copy()
        for at in r.sample(range(200), 3 + r.randrange(4)):
            w[at] = f"z{r.randrange(5)}"
        rows.append((i, " ".join(w)))
    numbers, sets = {}, []
    for _, t in rows:
        sets.append([numbers.setdefault(x, len(numbers)) for x in shingles(t)])
    table = np.zeros((len(rows), len(numbers)), np.float32)
    for i, own in enumerate(sets):
        table[i, own] = 1
    common, n = table @ table.T, table.sum(axis=1)
    links = np.argwhere(np.triu(100 * common >= 75 * (n[:, None] + n - common), 1)).tolist()
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups(range(len(rows)), links)
    assert len(set(want.values())) > 100 and got == want


@pytest.mark.parametrize("unit", [1 << 14, 1])
def test_open_buckets_are_compared_by_all_pairs(spark, monkeypatch, unit):
    """Whatever single bucket two members share, and however far its band is from their others, they meet."""
    monkeypatch.setattr(minhash, "UNIT", unit)
    monkeypatch.setattr(minhash, "BLOCK", 2)
    r = random.Random(6)
    rows = [(key, i, 10, i % 4 * i) for key in range(12) for i in r.sample(range(40), r.randrange(3, 9))]
    sides = {}
    for x in minhash._units(spark.createDataFrame(rows, "key long, id long, n long, c long"), Scratch(spark, "t")).collect():
        sides.setdefault((x.unit, x.i, x.j), []).append((x.id, x["at"]))
    met = {frozenset((a, b)) for (_, i, j), own in sides.items() for a, p in own for b, q in own if p == i and q == j}
    want = {frozenset((a, b)) for k, a, _, c in rows for m, b, _, d in rows if k == m and c != d}
    assert want <= met


def test_chains_of_documents_whose_first_hub_has_only_pieces(spark):
    """Two documents share a passage, and a third one, first in order, has each of its stretches of four words among others: it takes no passage away."""
    r = np.random.default_rng(5)
    word = lambda n: ["w" + str(k) for k in r.integers(0, 1 << 40, n)]
    rows, groups = [], 40
    for g in range(groups):
        passage = word(30)
        pieces = [w for k in range(0, 27) for w in (*word(9), *passage[k : k + 4])]
        ids = sorted(range(3 * g, 3 * g + 3), key=lambda i: chains._ranks(np.array([i]))[0])
        rows += [(ids[0], " ".join(pieces)), *((i, " ".join([*word(25), *passage, *word(20)])) for i in ids[1:])]
    got = {frozenset((x.doc_id, x.partner_id)) for x in chains.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {frozenset(i for i, text in rows[k : k + 3][1:]) for k in range(0, len(rows), 3)}
    assert got == want


def test_hubs_go_on_over_batches():
    """Matches are the same however a seed's rows are cut into batches."""
    import pyarrow as pa

    r = np.random.default_rng(6)
    seed = np.sort(r.integers(0, 12, 400))
    bits = r.integers(0, 1 << 62, 5)[r.integers(0, 5, 400)]
    whole = pa.record_batch([pa.array(seed), pa.array(np.arange(400) // 2), pa.array(np.arange(400, dtype=np.int32)), pa.array(bits)], ["seed", "rank", "pos", "bits"])
    run = chains._meet(chains.LEAST, chains.IDENTITY)
    flat = lambda out: sorted(tuple(row.values()) for b in out for row in b.to_pylist())
    want = flat(run(iter([whole])))
    assert want and sum(x[4] for x in want) > 50
    for n in (1, 7, 64):
        assert flat(run(iter([whole.slice(k, n) for k in range(0, 400, n)]))) == want


def test_chains_send_stretches_once(spark):
    """One join holds the words of both sides, and a document's own stretches are not in any other."""
    words = [f"v{i}" for i in range(60)]
    rows = [(i, " ".join([f"a{i}_{k}" for k in range(50)] + words + [f"b{i}_{k}" for k in range(50)])) for i in range(5)]
    out = chains.passages(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.lstrip(" +-:").startswith("Join ") for x in plan.splitlines()) == 1
    got = out.collect()
    assert {x.n_equal for x in got} == {60} and {k for x in got for k in (x.doc_id, x.partner_id)} == set(range(5))
