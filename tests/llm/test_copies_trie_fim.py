"""Exact copies, the trie of conversations and fill-in-the-middle, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from helpers import same
from odd import lower
from pyspark.sql import functions as F

from orrery.llm import exact, fim, oracle, queries, trie
from orrery.llm.scratch import Scratch


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_prefix_trie", "op13_fill_in_middle"])
def test_queries_equal_their_sql(spark, duck, name):
    same(queries.queries()[name](spark, "/root/testdata/sf0.001"), duck.sql(oracle.SQL[name]))


# --- exact copies -----------------------------------------------------------------------------


def groups_of(rows):
    """(id, keep, size, sha) of each row, and the rows that stay, by text."""
    by = defaultdict(list)
    for i, t in rows:
        by[sha(lower(t))].append(i)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    return sorted(((i, top(ids), len(ids), h) for h, ids in by.items() for i in ids), key=repr), len(by)


@pytest.mark.parametrize("most", [exact.MOST, exact.CHUNK])
def test_exact_groups(spark, odd, odd_rows, empty, most):
    rows = [*odd_rows, *odd_rows[:5], (None, "Alone"), (None, "ALONE"), (None, odd_rows[0][1]), *((100 + k % 700, f"Text {k % 900} É") for k in range(9000)), *((7, "hot") for _ in range(4000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact.exact_groups(docs, most=most).collect()
    want, n = groups_of(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept) and len({r.text_sha256 for r in kept}) == n
    assert exact.exact_groups(empty, most=most).count() == 0


def test_distinct_texts_keeps_rows_whole(spark, odd, odd_rows):
    got = exact.distinct_texts(odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000)))
    assert got.columns == odd.columns
    want = {}
    for i, t in [*odd_rows, *((i + 1000, t) for i, t in odd_rows)]:
        want[lower(t)] = max(want.get(lower(t), -1), i)
    assert sorted((r.doc_id, lower(r.text)) for r in got.collect()) == sorted((i, t) for t, i in want.items())


def test_the_filter_lets_single_rows_pass(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") < 39_000, F.col("id")).otherwise(F.col("id") % 10).cast("string")).alias("text"))
    rows = exact.asked(exact.digests(docs), Scratch(spark, "exact"), 40_000)
    maybe = {r.id for r in rows.where("maybe").select("id").collect()}
    assert maybe >= {*range(39_000, 40_000), *range(10)}  # every repeat, also those of the hot texts
    assert len(maybe) - 1010 < 400  # and few others: 6 in 1,000 expected


# --- trie -------------------------------------------------------------------------------------


def rebuild(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), sha(f"{len(role)}:{role}{text}"), (role, text)))
    turns = {c: [t[2] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    return out


def brute(convs):
    members, chars = defaultdict(list), {(): 0}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                chars[tuple(turns[:d])] = len(turns[d - 1][1])
    out = {}
    for p in members:
        under = [q for q in members if q[: len(p)] == p]
        kids = lambda x: sum(len(q) == len(x) + 1 and q[: len(x)] == x for q in members)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(convs[c]) == len(p))))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), kids(p), sum(kids(q) == 0 for q in under), sum((len(members[q]) - 1) * chars[q] for q in under), sha(ends))
    return out


def found(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit("x")).withColumn("depth", F.lit(1)).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "ENDS", 3)
    r = random.Random(seed)
    rows = [(c, t, r.choice(["u", "a", None]), r.choice(["", "é", "long text", None])) for c in [*range(100, 160), 5, 205, *range(-3, 0)] for t in range(r.randint(1, 11))]
    rows += [(170 + k, t, "u", "same") for k in range(12) for t in range(9)]  # equal conversations
    rows += [(301, None, "u", "null first"), (301, 0, None, None), (301, 0, "a", "tie"), (301, 0, "a", "tie"), (None, 0, "u", "no conversation"), (404, 1, "u", "x")]
    assert found(queries.op12_prefix_trie(spark, write(spark, tmp_path, rows))) == brute(rebuild(rows))


def test_trie_of_a_conversation_with_most_turns(spark, tmp_path):
    rows = [(1, t, "u", str(t % 3)) for t in range(3000)] + [(c, t, "u", str(t % 3)) for c in range(2, 6) for t in range(20)]
    got = found(trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)))
    assert len(got) == 3001
    for d in range(3001):
        n = 5 if d <= 20 else 1
        ends = "2,3,4,5" if d == 20 else "1" if d == 3000 else ""
        assert got[1, d] == (1 if d else None, n, int(d < 3000), 1, 4 * max(0, 21 - max(d, 1)), sha(ends))


def test_trie_odd_tables(spark, tmp_path):
    assert found(queries.op12_prefix_trie(spark, write(spark, tmp_path / "none", []))) == {}
    # Turns that all go: h of 3 is 4, and it has no family.
    c = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 >= 2)
    assert found(queries.op12_prefix_trie(spark, write(spark, tmp_path / "bare", [(c, 0, "u", "x")]))) == {(c, 0): (None, 1, 0, 1, 0, sha(str(c)))}


# --- fill in the middle -----------------------------------------------------------------------


def arranged(i, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = sha("1:" + ("" if i is None else str(i)))
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", p, m, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, odd_rows, empty):
    texts = ["a b\r\n\x00c", "😀 x😀y", "<P> is in it", "almost < P>S><", "<", "<P", "S>M>", "x" * 300_000, "1" * 100_000, "aB" + "<" * 9 + "M>"]
    rows = [*odd_rows, *((1000 + 7 * k, texts[k % len(texts)]) for k in range(200)), (None, "no id here"), (None, None), (3, "again")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, fim string").withColumn("_units", F.lit(1)).repartition(3)
    out = fim.arranged(docs)
    assert out.columns == ["doc_id", "text", "_units", "fim"]
    got = out.select("doc_id", "text", "fim.n", "fim.form", "fim.prefix", "fim.middle", "fim.output", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back")).collect()
    assert sorted((tuple(r)[2:7] for r in got), key=repr) == sorted((arranged(i, t) for i, t in rows), key=repr)
    assert all(r.back == (r.text or "") and r.n == arranged(r.doc_id, r.text)[0] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.arranged(empty).count() == 0


def test_fill_in_middle_rates(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r.form: r["count"] for r in fim.arranged(docs).groupBy("fim.form").count().collect()}
    assert abs(n["plain"] - 2000) < 200 and abs(n["spm"] - 3600) < 250
