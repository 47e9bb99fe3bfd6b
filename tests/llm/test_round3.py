"""Prefix trie, fill-in-middle and the hash index against plain code."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from cases import make_docs

from plumbline.llm import hash_index, infill, trie

TURNS = "conv_id long, turn long, role string, text string, depth long, a long, n_convs string"


def talks(seed, n=30, most=12):
    """Conversations that share first turns, with repeated turns, nulls, and ids far apart."""
    r = random.Random(seed)
    rows = []
    ids = r.sample(range(60), n) + [-7, 1000, 1001, 1004]
    for c in ids:
        text = [r.choice(["hi", "hello there", None, "", "é字"]) for _ in range(2)] if r.random() < 0.7 else []
        for k in range(r.randint(1, most)):
            t = text[k] if k < len(text) else r.choice(["ok", "no", f"w{r.randrange(4)}", None])
            rows.append((c, k if r.random() < 0.95 else None, r.choice(["user", "user", "bot", None]), t))
    rows += [(None, 0, "user", "x"), (3, 0, "user", "twice"), (3, 0, "user", "twice"), (3, 0, "user", "other")]
    return rows


def nodes(df):
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_brute_force(spark, seed):
    rows = talks(seed)
    df = spark.createDataFrame([(*x, 1, 2, "n") for x in rows], TURNS).repartition(3)
    got = nodes(trie.rollup(df))
    want = sorted(trie.brute(rows), key=lambda x: (x[0], x[1], x[2] if x[2] is not None else -1, *x[3:]))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_trie_sql(spark):
    df = spark.createDataFrame([(*x, 1, 2, "n") for x in talks(5)], TURNS)
    con = duckdb.connect()
    conversations = df.toArrow()  # noqa: F841
    want = con.execute(trie.ORACLE).fetchall()
    assert sorted(map(str, nodes(trie.rollup(df)))) == sorted(map(str, want))


def test_trie_rounds_and_long_conversations(spark, monkeypatch):
    """Pointers of a chain of 100 turns move in seven rounds; members of one node are digested in several blocks."""
    monkeypatch.setattr(trie, "BLOCK", 3)
    rounds, written = [], trie.written
    monkeypatch.setattr(trie, "written", lambda df: rounds.append(df.columns) or written(df))
    rows = [(0, k, "user", f"t{k}") for k in range(100)] + [(c, 0, "user", "same") for c in range(5, 100, 5)]
    got = {(r[0], r[1]): r for r in nodes(trie.rollup(spark.createDataFrame([(*x, 1, 2, "n") for x in rows], TURNS)))}
    assert got[0, 0][3:6] == (20, 2, 2) and got[0, 1][5] == 1 and got[5, 1][3] == 19
    assert got[5, 1][7] == hashlib.sha256(",".join(map(str, range(5, 100, 5))).encode()).hexdigest()
    assert got[0, 0][6] == 18 * 4
    assert len([c for c in rounds if "qa" not in c and c[:2] == ["a", "b"] and "depth" not in c and "n_leaves" in c]) == 7


def test_trie_turnless_and_empty(spark):
    lost = next(c for c in range(1, 60) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    df = spark.createDataFrame([(lost, 0, "user", "gone", 1, 2, "n")], TURNS)
    assert nodes(trie.rollup(df)) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
    assert trie.rollup(df.limit(0)).collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, 1, 2, "n")], TURNS)
    assert trie.rollup(nulls).collect() == []


def form_of(i, t, seed="1"):
    """(n, form, prefix_chars, middle_chars, output) by tokens."""
    t = t or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    n, h = len(tokens), hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk,piece", [(512, 1 << 20), (3, 7), (1, 1)])
def test_infill(spark, monkeypatch, chunk, piece):
    monkeypatch.setattr(infill, "CHUNK", chunk)
    monkeypatch.setattr(infill, "PIECE", piece)
    rows = make_docs(60, 4) + [(None, "a null id"), (None, None), (200, "has <M> in it"), (201, "<"), (202, "S><P"), (203, "<<S><"), (204, "字" * 50), (205, "word"), (205, "word")]
    rows += [(300 + k, f"ab<{k}S> <P x" + "é1 " * k) for k in range(40)]
    # the module's values travel to workers only as closures, so the worker is called here
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int64()), pa.array([t for _, t in part], pa.string())], names=["doc_id", "text"]) for part in (rows[:50], rows[50:])]
    got = [tuple(r.values())[1:] for b in infill._forms("1", 10, 20)(iter(batches)) for r in b.to_pylist()]
    assert got == [form_of(*x) for x in rows]
    assert {f for _, f, *_ in got} == {"plain", "psm", "spm"}


def test_infill_on_spark(spark):
    rows = make_docs(60, 4) + [(None, "a null id"), (None, None), (7, "two"), (7, "two")] + [(500, "long " * 300_000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n long, form string").repartition(3)
    got = infill.restored(infill.transformed(docs)).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got), key=key) == sorted(((i, *form_of(i, t), t or "") for i, t in rows), key=key)
    assert infill.digest(docs.limit(0)).collect() == []
    other = {r.doc_id: r.output for r in infill.transformed(docs, seed="2").collect()}
    assert sum(other[r.doc_id] != r.output for r in got) > 20


def plain_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        who = groups[t or ""]
        keep = max((x for x in who if x is not None), default=None)
        out.append((i, keep, len(who), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(str, out))


def answered(df):
    return sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


def copy_rows(seed=3):
    r = random.Random(seed)
    rows = make_docs(80, seed)
    rows += [(100 + k, r.choice(rows)[1]) for k in range(60)] + [(300 + k, "the same") for k in range(150)]
    return rows + [(None, "null id"), (None, "the same"), (None, None), (400, "the same"), (400, "the same"), (401, "the same "), (402, "The same"), (403, "x" * 200_000), (404, "x" * 200_000), (405, "x" * 199_999 + "y")]


@pytest.mark.parametrize("capacity", [None, 2, 40])
def test_copies(spark, capacity):
    rows = copy_rows()
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n long, h string").repartition(5)
    assert answered(hash_index.copies(docs, capacity=capacity)) == plain_copies(rows)
    assert hash_index.copies(docs.limit(0)).collect() == []


def test_directory_doubles_only_overfull_buckets(spark):
    keys = spark.range(2000).selectExpr("xxhash64(id) as h", "1L as n", "10L as bytes")
    got = hash_index.directory(keys, 50).collect()
    assert sum(r.n_keys for r in got) == 2000 and max(r.n_keys for r in got) <= 50
    depths = {r.depth for r in got}
    assert len(depths) > 1 and sum(2.0**-r.depth for r in got) == 1.0  # buckets cover all prefixes once
    counts = {}
    for r in got:
        for d in range(r.depth):
            counts[d, r.prefix >> (r.depth - d)] = counts.get((d, r.prefix >> (r.depth - d)), 0) + r.n_keys
    start = 5  # 2 ** 5 buckets of 50 do not hold 2,000 keys
    assert all(n > 50 for (d, _), n in counts.items() if d >= start)


def test_hot_copies_are_dealt_over_pages(spark):
    rows = [(k, "hot") for k in range(500)] + [(1000 + k, f"t{k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder = hash_index.shared_folder(spark)
    found = hash_index.build(hash_index._items(docs, "doc_id", "text"), folder, 20).collect()
    assert len(found) == 101 and {(r.text, r.keep_id, r.n) for r in found if r.text == "hot"} == {("hot", 499, 500)}
    written = spark.read.parquet(f"{folder}/entries").where("text = 'hot'").collect()
    assert len(written) > 5 and sum(r.n for r in written) == 500


def test_colliding_keys_form_chains(spark, monkeypatch):
    """With a key of three values every bucket holds chains, and bytes alone tell texts apart."""
    F = hash_index.F
    real = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *c: real(*c) if len(c) > 1 else F.pmod(F.length(F.col(c[0]) if isinstance(c[0], str) else c[0]), F.lit(3)).cast("long"))
    rows = copy_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert answered(hash_index.copies(docs, capacity=2)) == plain_copies(rows)


def test_index_keeps_batches(spark):
    rows = copy_rows(7)
    root = hash_index.shared_folder(spark)
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    first, second = rows[:120], rows[120:]
    assert answered(hash_index.insert(frame(first), root, capacity=8)) == plain_copies(first)
    both = plain_copies(rows)
    got = answered(hash_index.insert(frame(second), root, capacity=8))
    assert len(got) == len(second) and set(got) <= set(both)
    assert hash_index.versions(spark, root) == [1, 2]
    kept = hash_index.entries(spark, f"{root}/v2")
    assert kept.count() == len({t or "" for _, t in rows}) and kept.agg({"n": "sum"}).first()[0] == len(rows)
    with pytest.raises(Exception, match="(?i)exists"):
        hash_index.build(hash_index._items(frame(second), "doc_id", "text"), f"{root}/v2")


def test_without_copies(spark):
    rows = [(1, "a", "s"), (2, "a", "s"), (2, "a", "t"), (3, None, "s"), (4, "", "s"), (None, "b", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, copiesid string")
    got = sorted(map(tuple, hash_index.without_copies(docs).collect()), key=str)
    assert got == sorted([rows[1], rows[2], rows[4], rows[5]], key=str)


def test_native_plan(spark):
    plan = hash_index.copies(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
