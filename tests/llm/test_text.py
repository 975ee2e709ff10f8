"""Decontamination, mixing, tokens, codec, quality and language models, and the pipeline."""

import hashlib
import itertools
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from helpers import DATA, same
from odd import lower, prose
from orrery.llm import codec, decontaminate, mixing, ngram, oracle, quality, queries, tokens
from orrery.llm.words import ALNUM, VISIBLE, Words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9 é-\t\n日 .", max_size=30), max_size=6))
def test_words(texts):
    for kind, pattern in ((VISIBLE, r"[^\x20\x09-\x0D]+"), (ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = Words(pa.array(texts, pa.string()), kind)
        for i, t in enumerate(texts):
            own = [w.word(k).decode() for k in range(w.first[i], w.first[i + 1])]
            assert own == re.findall(pattern, lower(t))
        seen = {}
        for k in range(len(w.start)):
            assert seen.setdefault(int(w.hash[k]), w.word(k)) == w.word(k)


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, odd, odd_rows, empty, block):
    long = next(t for i, t in odd_rows if i == 11)
    items = [(1, " ".join(long.split()[100:140])), (2, "One, TWO!"), (3, None), (4, ""), (5, "one two"), (6, prose(5, 13)), (7, prose(99, 40)), (5, "one two"), (10, "日本語")]
    win = {}
    for i, t in items:
        w = alnum(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            win.setdefault(tuple(w[j : j + 13]), set()).add(str(i))
    want = {}
    for i, t in odd_rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in win}:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in win:
                    hit.update(range(p, p + n))
                    found |= win[k]
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'i' as item", "1 as w")
    rows = decontaminate.contamination(odd, bench, block=block).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == want
    assert all(sum(x.e - x.s for x in r.runs) == r.n_hit for r in rows)
    assert len(decontaminate.contamination(odd.union(odd), bench, block=block).collect()) == 2 * len(odd_rows)
    assert decontaminate.contamination(empty, bench, block=block).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd, bench.where("false"), block=block).collect())


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_by_items_without_an_id(spark, block):
    a, b = prose(31, 30), prose(32, 30)
    docs = spark.createDataFrame([(1, a), (2, f"{a} {b}"), (3, prose(33, 30)), (4, b)], "doc_id long, text string")
    n = {1: len(alnum(a)), 2: len(alnum(f"{a} {b}")), 3: 0, 4: len(alnum(b))}
    for items, hit, named in (([(None, a)], {1: n[1], 2: n[1], 4: 0}, ()), ([(None, a), (7, b), (8, a)], n, (1, 2, 4)), ([(None, a), (7, b)], n, (2, 4))):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = {r.doc_id: r for r in decontaminate.contamination(docs, bench, block=block).collect()}
        for i, r in got.items():
            assert r.n_hit == hit.get(i, 0) and r.contaminated == (r.n_hit > 0) and (r.n_items > 0) == (i in named)


def test_mixing(spark, odd, empty):
    rows = mixing.plan(odd, block=4).collect()
    assert len(rows) == 17 and all(0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(odd.repartition(3), block=4).collect()))
    total = sum(r.size for r in rows)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * 20 + 0.02 * own[0].target
    for r in rows:
        runs = mixing.copies(r.size, r.start, r.shard_size, r.n, r.q, r.stride, r.shift)
        assert sum(b - a for _, a, b in runs) == r.taken
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    out = mixing.mixed(odd, block=4)
    assert out.columns == odd.columns and sum(words(r.text) for r in out.collect()) == sum(r.taken for r in rows)
    assert mixing.plan(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_sainte_lague(spark):
    df = spark.createDataFrame([("a", 53), ("b", 24), ("c", 23), ("d", 0)], "k string, v long").selectExpr("*", "7L as seats")
    assert {r.k: r.quota for r in mixing.sainte_lague(df, "k", "v", "seats", ["seats"]).collect()} == {"a": 3, "b": 2, "c": 2, "d": 0}
    r = random.Random(1)
    for _ in range(3):
        w = [r.randrange(1, 1000) for _ in range(9)]
        n = r.randrange(1, 400)
        rank = sorted(((-x / (2 * s + 1), k) for k, x in enumerate(w) for s in range(n)))[:n]
        df = spark.createDataFrame(list(enumerate(w)), "k int, v long").selectExpr("*", f"{n}L as seats")
        assert {x.k: x.quota for x in mixing.sainte_lague(df, "k", "v", "seats", ["seats"]).collect()} == {k: sum(b == k for _, b in rank) for k in range(9)}


ODD_TEXT = st.text(alphabet=st.sampled_from(list("ab 'd\t\n\r7.é日 　\u0085 \x1c‘<|>")), max_size=40)


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@settings(max_examples=150, deadline=None)
@given(st.lists(ODD_TEXT | st.sampled_from(["<|endoftext|>", "x <|endoftext|>  y", "it's we'll  ", "  "]), max_size=8))
def test_tokenizer_equals_the_library(texts):
    from tokenizers import Tokenizer

    own, ref = tokens.tokenizer(tokens.default_tokenizer()), Tokenizer.from_file(tokens.default_tokenizer())
    ids, counts = own.encode(pa.array(texts, pa.string()))
    want = [ref.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_tokenizer_cache_can_be_emptied(library):
    own = tokens.Tokenizer(tokens.default_tokenizer(), limit=40)
    for seed in range(4):
        text = prose(seed, 90)
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_met_again_are_encoded_once(library):
    own, sent = tokens.Tokenizer(tokens.default_tokenizer(), limit=40), []
    encode = own._library
    own._library = lambda data, start, end: (sent.append(len(start)), encode(data, start, end))[1]
    words = ["".join(x) for x in itertools.product("bdfgk", "aeiou", "lmnrt", "aeo")]
    for k in range(12):
        text = "x " + " ".join(words[:20] + words[20 + 25 * k : 45 + 25 * k])
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
    # 12 x 25 words that come once, 21 that come each time; a few share their places.
    assert 321 <= sum(sent) <= 335


@pytest.mark.parametrize("symbols", [1, 2, 700, 8190, 8191, 8192, 20_000])
def test_codec_of_many_symbols(symbols):
    r = np.random.default_rng(symbols)
    ids = np.concatenate([np.arange(symbols), (r.zipf(1.2, 20_000) - 1) % symbols, np.tile(r.integers(0, symbols, 300), 9)]).astype(np.uint32) * 3
    keys, lengths = np.array([7]), np.array([len(ids)])
    data = codec.encode(ids, keys, lengths)
    assert all((a == b).all() for a, b in zip(codec.decode(data), (ids, keys, lengths), strict=True))
    of = codec.Symbols(np.bincount(ids // 3))
    assert np.iinfo(of.slot).max >= symbols << 3 | 7


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_codec_round_trip(n):
    r = np.random.default_rng(n)
    for ids in (r.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32), r.zipf(1.3, n).clip(0, 60000).astype(np.uint32), np.zeros(n, np.uint32)):
        cut = n // 3
        keys, lengths = np.array([-5, 2, 2]), np.array([cut, 0, n - cut])
        data = codec.encode(ids, keys, lengths)
        got = codec.decode(data)
        assert all((a == b).all() for a, b in zip(got, (ids, keys, lengths), strict=True))
        for at in {4, len(data) // 2, len(data) - 1}:
            bad = bytearray(data)
            bad[at] ^= 0x41
            with pytest.raises((codec.FileError, zlib.error, ValueError, IndexError)):
                back = codec.decode(bytes(bad))
                if all(len(a) == len(b) and (a == b).all() for a, b in zip(back, got, strict=True)):
                    raise codec.FileError("nothing was changed by this bit")  # unused end of a block
        if n:
            with pytest.raises(codec.FileError):
                codec.decode(data[:-1])
    assert len(codec.encode(np.zeros(5000, np.uint32), np.array([1]), np.array([5000]))) < 400


def expected_ids(rows, library, end):
    start, out = 0, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, end], "<u4")
        out[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_token_ids(odd, odd_rows, empty, library):
    got = {r.doc_id: tuple(r)[1:] for r in tokens.token_ids(odd).collect()}
    assert got == expected_ids(odd_rows, library, 2)
    assert tokens.token_ids(empty).count() == 0
    twice = tokens.token_ids(odd.union(odd)).collect()
    assert len(twice) == 34 and sum(r.n_tokens for r in twice) == 2 * sum(v[1] for v in got.values())


def test_token_counts(odd, odd_rows, empty, library):
    got = {r.doc_id: tuple(r)[1:] for r in tokens.document_tokens(odd).collect()}
    assert got == {k: v[:2] for k, v in expected_ids(odd_rows, library, 50256).items()}
    assert tokens.document_tokens(empty).count() == 0


@pytest.mark.parametrize("block", [2, 6, 1 << 20])
def test_separator_scan_stitches_blocks(spark, tmp_path, block):
    parts = [[1, 2, 9, 9, 3], [], [4, 4, 4, 4, 4, 4, 4], [9, 5, 9, 6, 6]]
    rows = []
    for k, ids in enumerate(parts):
        (tmp_path / f"{k}.bin").write_bytes(np.array(ids, "<u2").tobytes())
        rows.append((k, f"file://{tmp_path}/{k}.bin", 2 * len(ids)))
    df = spark.createDataFrame(rows, "part int, path string, bytes long")
    got = sorted(tuple(r) for r in tokens.count_tokens(df, 9, block=block).collect())
    assert got == [(0, 0, 3), (1, 3, 1), (2, 4, 9), (3, 13, 2), (4, 15, 2)]
    assert tokens.count_tokens(df.where("false"), 9).count() == 0


def test_quality(spark, odd, empty):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.scored(docs, model)
    rows = {r.doc_id: r for r in got.collect()}
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert len(quality.scored(odd, model).collect()) == 17 and quality.scored(empty, model).count() == 0
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.scored(odd, model).collect() if r.predicted}
    flat = quality.train(docs, labels.where("quality = 1"))
    assert all(0.5 < r.score < 1 for r in quality.scored(odd, flat).collect())
    assert quality.scored(odd, quality.train(docs, labels.where("false"))).count() == 17


def expected_losses(rows, drawn, target, texts_of_a_key):
    """Losses by counts of the strings themselves; ``drawn`` are the ids of the background."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for i, t in rows]
    grams = [(Counter(w), Counter(zip(["", *w], w, strict=False))) for _, w in texts]
    models = [lambda i: i in target, lambda i: i in drawn]
    counted = [g for (i, _), g in zip(texts, grams, strict=True) if i in target or i in drawn]
    known = {x for x, n in Counter(x for words, _ in counted for x in words).items() if n >= texts_of_a_key}
    known_pairs = {x for x, n in Counter(x for _, pairs in counted for x in pairs).items() if n >= texts_of_a_key}
    out = []
    for (i, w), (own, own_pairs) in zip(texts, grams, strict=True):
        losses = []
        for fits in models:
            members = [k for k, (j, _) in enumerate(texts) if fits(j)]
            words, pairs, starts = Counter(), Counter(), sum(1 for k in members if texts[k][1])
            starts *= sum(1 for j, v in texts if v and (j in target or j in drawn)) >= texts_of_a_key
            for k in members:
                words.update(grams[k][0])
                pairs.update(grams[k][1])
            total = sum(n for x, n in words.items() if x in known)
            mine = 1 if fits(i) else 0
            loss = 0.0
            for b, x in zip(["", *w], w, strict=False):
                base = max(0, (starts - mine) if b == "" else (words[b] - mine * own[b]) * (b in known))
                pair = max(0, pairs[b, x] - mine * own_pairs[b, x]) * ((b, x) in known_pairs)
                loss -= np.log(0.7 * min(pair / max(base, 1), 1) + 0.3 * (max(0, words[x] - mine * own[x]) * (x in known) + 1) / (total + len(known) + 1))
            losses.append(loss / max(1, len(w)))
        out.append((i, len(w), *losses))
    return out


def check_losses(spark, df, rows, target, **texts):
    named = df.select("doc_id").distinct()
    size = lambda ids: sum(len((t or "").encode()) for i, t in rows if i in ids)
    share = min(1.0, size(target) / max(1, size({i for i, _ in rows}) - size(target)))
    drawn = {r.doc_id for r in named.selectExpr("doc_id", "pmod(xxhash64(doc_id, 17), 1 << 30) as h").collect() if r.h is not None and r.h < int(share * (1 << 30)) and r.doc_id not in target}
    got = ngram.cross_entropy_difference(df, spark.createDataFrame([(i,) for i in target] + [(None,), *[(i,) for i in target]], "doc_id long"), **texts).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.target_loss, r.background_loss, r.score) for r in got)
    want = sorted((i if i is not None else -1, *x) for i, *x in expected_losses(rows, drawn, target, texts.get("texts", 1)))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:4] == pytest.approx(w[2:], rel=1e-5) and g[4] == pytest.approx(w[2] - w[3], abs=1e-5)
    return {g[0]: g for g in got}


def test_language_models(spark, odd, odd_rows, empty):
    check_losses(spark, odd, odd_rows, {0, 11})
    check_losses(spark, odd, odd_rows, set())
    rows = [*odd_rows, *odd_rows[:4], (None, prose(1, 80)), (None, prose(1, 80))]
    got = check_losses(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, {0, 3})
    assert got[5][2:] == got[6][2:] == (0, 0, 0)
    assert ngram.cross_entropy_difference(empty, empty.select("doc_id")).count() == 0


@pytest.mark.parametrize(("head", "texts"), [(1 << 19, 1), (30, 1), (0, 1), (30, 3)])
def test_language_models_by_every_way(spark, monkeypatch, head, texts):
    """Heads that hold all, some or none of the words and pairs, many buckets, and target ids that aren't sent."""
    monkeypatch.setattr(ngram, "HEAD", head)
    monkeypatch.setattr(ngram, "WORDS_HEAD", head)
    monkeypatch.setattr(ngram, "BUCKET", 4096)
    monkeypatch.setattr(ngram, "SENT_IDS", 5)
    r = random.Random(7)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.6))}" if r.random() < 0.8 else f"x{r.randrange(3000)}" for _ in range(r.randrange(120)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 6)] + [(200, None)]
    check_losses(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, set(range(0, 60, 3)), texts=texts)


def test_language_models_ask_for_what_may_be_counted_alone(spark, monkeypatch):
    """Words that no other text has are not asked for, by texts of the models or not; pairs are asked for in their block."""
    asked, write = [], ngram.Scratch.write
    monkeypatch.setattr(ngram.Scratch, "write", lambda self, df, name: (out := write(self, df, name), name == "asked" and asked.append(out))[0])
    monkeypatch.setattr(ngram, "HEAD", 0)
    monkeypatch.setattr(ngram, "WORDS_HEAD", 0)
    rows = [(i, " ".join(f"u{i}_{k}" for k in range(60))) for i in range(30)]
    check_losses(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows, set(range(10)))
    assert asked[0].selectExpr("sum(size(rare))").first()[0] < 180  # the 30 first words follow the start mark, which is asked for
    shift = 65 - ngram.BLOCKS.bit_length()
    for k in range(ngram.BLOCKS):
        assert asked[0].selectExpr(f"explode(pair{k}) as p").where(f"shiftrightunsigned(p, {shift}) != {k}").isEmpty()


def test_language_models_ask_once_for_each_pair_of_a_slice(spark, monkeypatch):
    """However many texts of a slice have a pair, it is one entry, so that what is shuffled doesn't grow faster than the texts."""
    asked, write = [], ngram.Scratch.write
    monkeypatch.setattr(ngram.Scratch, "write", lambda self, df, name: (out := write(self, df, name), name == "asked" and asked.append(out))[0])
    monkeypatch.setattr(ngram, "HEAD", 0)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randrange(12)}" for _ in range(80))) for i in range(40)]
    check_losses(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), rows, set(range(0, 40, 2)))
    pairs = {x for _, t in rows for x in zip(["", *t.split()], t.split(), strict=False)}
    assert sum(asked[0].selectExpr(*(f"sum(size(pair{k}))" for k in range(ngram.BLOCKS))).first()) == len(pairs)


def test_tables_sent_to_tasks_are_small_and_whole():
    r = np.random.default_rng(3)
    keys = np.sort(r.integers(-(1 << 63), 1 << 63, 50_000))
    bits = np.zeros((2, 1 << 20), np.uint8)
    bits[:, r.integers(0, 1 << 20, 5_000)] = 1
    for one in (ngram.Known(keys, r.integers(0, 9, (2, 50_000)).astype(np.uint32), bits), ngram.Known(keys[:0], np.zeros((2, 0), np.uint32), None)):
        data = pickle.dumps(one)
        two = pickle.loads(data)
        assert (one.keys == two.keys).all() and (one.counts == two.counts).all() and (one.bits is None and two.bits is None or (one.bits == two.bits).all())
        assert len(data) < 1000 + 0.6 * (one.keys.nbytes + one.counts.nbytes)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    same(queries.queries()[name](spark, f"{DATA}/sf0.001"), duck.sql(oracle.SQL[name]))


def test_pipeline_stages(spark, library):
    """Each stage against the rule it stands for, over what the stage before it kept."""
    import corpus_pipeline as P
    from test_dedup import brute

    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in P.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(docs.collect())
    quality_kept, distinct, clean, mix = kept
    good = {r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality == 1}
    assert good & {r.doc_id for r in quality_kept} and len(good - {r.doc_id for r in quality_kept}) <= 2
    assert {r.doc_id for r in distinct} == {i for i, v in brute([(r.doc_id, r.text) for r in quality_kept]).items() if v[2]}
    bench = {tuple(w[j : j + 13]) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect() for w in [alnum(r.text)] for j in range(max(1, len(w) - 12))}
    bad = set()
    for r in distinct:
        w, hit = alnum(r.text), set()
        for p in range(len(w) - 12):
            if tuple(w[p : p + 13]) in bench:
                hit.update(range(p, p + 13))
        if hit and 20 * len(hit) >= len(w):
            bad.add(r.doc_id)
    assert {r.doc_id for r in clean} == {r.doc_id for r in distinct} - bad
    assert {r.doc_id for r in mix} <= {r.doc_id for r in clean}
    last = P.STAGES[4][1](spark, docs, d).collect()
    assert len(last) == len(mix) and sum(r.n_tokens for r in last) == sum(len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix)
    starts = sorted((r.start, r.n_tokens) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))


@pytest.fixture(scope="session")
def odd_folder(spark, odd, tmp_path_factory):
    """Labels and a benchmark for the odd rows, and the rows with repeated and null ids among them."""
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    labels = [(i, int(i % 2 == 0), 0) for i in range(17)] + [(3, 1, 0), (None, 1, 0), (4, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    items = [(1, prose(5, 13)), (None, prose(4, 60)), (2, None), (3, ""), (4, "one two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    extra = odd.where("doc_id in (0, 6, 11)").unionByName(odd.where("doc_id in (3, 5, 14)").withColumn("doc_id", F.lit(None).cast("long")))
    return folder, odd.unionByName(extra)


def test_pipeline_stages_on_odd_rows(spark, odd, odd_folder, empty):
    """Nulls, empty texts, ties, repeated rows and ids, clashing names and empty tables, stage by stage."""
    import corpus_pipeline as P

    folder, rows = odd_folder
    stages = dict(P.STAGES)
    for name, stage in P.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "token_ids" or (out.columns == empty.columns and out.dtypes == empty.dtypes))
    kept = stages["quality"](spark, rows, folder).collect()
    by_text = {}
    for r in kept:
        by_text.setdefault(r.text or "", 0)
        by_text[r.text or ""] += 1
    assert all(n == rows.where(rows.text.eqNullSafe(t) if t else "coalesce(text, '') = ''").count() for t, n in by_text.items())
    out = stages["near_dedup"](spark, rows, folder)
    assert out.columns == rows.columns and sorted(r.doc_id for r in out.collect()) == [0, 4, 5, 6, 7, 8, 10, 11, 13, 14, 15, 16]
    out = stages["decontamination"](spark, rows, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted([(False, i) for i in [*range(8), 10, 11, 12, 13, 16, 0, 6, 11]] + [(True, 0)] * 3)
    out = stages["mixing"](spark, rows, folder)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows.collect():
        total[r.source] = total.get(r.source, 0) + size(r.text)
    taken = {}
    for r in out.collect():
        assert size(r.text) > 0
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    assert out.columns == rows.columns and all(n <= 3 * total[s] for s, n in taken.items())
    assert abs(sum(taken.values()) - sum(total.values())) <= 64 * len(total)
    last = stages["token_ids"](spark, rows, folder).collect()
    assert len(last) == rows.where("doc_id is not null").count()
    starts = sorted((r.start, r.n_tokens) for r in last)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and [r.n_tokens for r in last if r.doc_id == 6] == [1, 1]


def test_conflicting_and_null_labels(spark, odd, odd_folder):
    folder, rows = odd_folder
    model = quality.train(rows, spark.read.parquet(f"{folder}/labels.parquet"))
    got = quality.scored(rows, model).collect()
    assert len(got) == rows.count() and not any(r.held_out for r in got if r.doc_id is None)


def test_tokens_of_repeated_and_null_ids(spark, odd_folder):
    _, rows = odd_folder
    counted = tokens.document_tokens(rows).collect()
    assert len(counted) == rows.where("doc_id is not null").count() and all(r.n_tokens == 1 for r in counted if r.doc_id in (5, 6))


def test_mixing_of_repeated_and_null_ids(spark, odd_folder):
    _, rows = odd_folder
    plan = mixing.plan(rows, block=4).collect()
    assert len(plan) == rows.count() and all(0 <= r.taken <= 3 * r.size for r in plan)


def test_decontamination_tells_rows_of_one_id_apart(spark):
    """In several blocks too, where rows of one id and the same words in another order meet."""
    words = prose(41, 40).split()
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words[::-1])), (1, " ".join(words[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[5:30]))], "item_id long, text string")
    for block in (200_000, 3):
        assert sorted(r.n_hit for r in decontaminate.contamination(docs, bench, block=block).collect()) == [0, 0, 25]
