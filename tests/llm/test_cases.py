"""Every operator over the awkward table: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import re

import pytest
import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, body string, fp long, block int, key string, size long, rank int, start long"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 5
TEXTS = [
    (1, "Hello there, write to jane.doe@mail.example.com or +1 (986) 555-2531 now", "a"),
    (2, None, None), (3, "", "a"), (4, "   \t\n", "b"), (5, "one", "b"), (6, "One two", "c"), (7, "same text here", "a"), (8, "same text here", "a"), (8, "same text here", "a"),
    (9, LONG, "hot"), (10, LONG + " end", "hot"), (11, "start " + PASSAGE, "hot"), (12, PASSAGE + "finish", "hot"), (13, PASSAGE, ""), (None, "no id at all", "a"), (14, "çédille Ünï \U0001f600 4493434194505928 40.116.220.95 300.1.1.1 1.2.3", "é"),
    (15, None, "z"), (16, "www.example.org/a?b=1 and http://x.example/y. token = \"48160bb3fce0c31ad44167de7d05e47a\"", "z"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), "clash", 1, 2, "k", 3, 4, 5) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text, fold=True):
    data = (text or "").encode()
    return (data.lower() if fold else data).split()


def test_equal_rows_spread_over_blocks(spark):
    from tessera.llm.common import in_blocks, settled

    docs = spark.sql("select 7L doc_id, repeat('x', 300) text from range(0, 100000, 1, 4)")
    sizes = [r["count"] for r in in_blocks(settled(docs), 40).groupBy("block").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 6 * 2048 and len(sizes) > 20
    moved = docs.repartition(3)
    assert settled(docs) is docs and settled(moved) is not moved and settled(moved).count() == 100_000


def test_messages_grow_with_blocks_and_not_with_their_square(spark, monkeypatch):
    """Many small blocks and as many shards, each block with something for every shard."""
    import pyarrow as pa

    from tessera.llm import common as c

    monkeypatch.setattr(c, "FAN", 8)
    sent = spark.sparkContext.accumulator(0)

    def ask(docs):
        block = docs.column("block")[0].as_py()
        return c.messages(["shard", "block", "payload"], list(range(n)), [block] * n, [bytes([block % 251, s % 251]) for s in range(n)])

    def add(payloads):
        return b"".join(payloads)

    def part(payloads, reply):
        assert reply == add(payloads)
        return list(payloads)

    def answer(asked):
        sent.add(asked.num_rows)
        return c.messages(["block", "shard", "payload"], asked.column("block").to_pylist(), asked.column("shard").to_pylist(), asked.column("payload").to_pylist())

    counts = []
    for n in (16, 64):
        blocks = spark.range(n).selectExpr("cast(id as int) block")
        before = sent.value
        got = c.exchange(blocks.groupBy("block").applyInArrow, ask, lambda asked: asked.groupBy("shard").applyInArrow(answer, c.TOLD), add, part, n).collect()
        counts.append(sent.value - before)
        told = {}
        for r in got:
            told.setdefault(r.block, {}).update(c.unbundle(bytes(r.payload)))
        assert told == {b: {s: bytes([b % 251, s % 251]) for s in range(n)} for b in range(n)} and len(got) <= 8 * n
    assert counts == [16 * 16 // 2, 64 * 64 // 8]


# --- exact dedup ---------------------------------------------------------------------------------------------


def test_exact_dedup(docs, no_docs):
    from tessera.llm.exact_dedup import exact_groups

    for keep, pick in (("largest", max), ("smallest", min)):
        groups = {}
        for i, t, _ in TEXTS:
            groups.setdefault(t or "", []).append(i)
        want = []
        for i, t, _ in TEXTS:
            ids = [x for x in groups[t or ""] if x is not None]
            keep_id = pick(ids) if ids else None
            want.append((i, keep_id, len(groups[t or ""]), i == keep_id, hashlib.sha256((t or "").encode()).hexdigest()))
        assert rows_of(exact_groups(docs, keep=keep)) == sorted(want, key=repr)
    assert exact_groups(no_docs).count() == 0


def test_lsm_filters_rule_out_and_merge(spark):
    from tessera.llm import exact_dedup as x

    entries = spark.sql("select id doc_id, unhex(sha2(cast(id % 700 as string), 256)) digest from range(1000)")
    assert x.flush(entries, 4).select("run").distinct().count() == 4
    for memtable_rows, fan in ((1000, 16), (250, 2), (20, 4)):  # one level, two, three
        runs = x.build(entries, 1000, memtable_rows, fan)
        got = {(r.run, r.low, r.high, r.n) for r in runs.collect()}
        assert got == {(0, i, i + 700 if i < 300 else i, 2 if i < 300 else 1) for i in range(700)}


def test_lsm_over_many_memtables(docs):
    from tessera.llm.exact_dedup import exact_groups

    assert rows_of(exact_groups(docs, keep="largest", memtable_rows=1)) == rows_of(exact_groups(docs, keep="largest"))


def test_texts_that_share_a_digest_are_told_apart(spark, monkeypatch):
    from tessera.llm import exact_dedup as x

    monkeypatch.setattr(x.F, "sha2", lambda c, bits, sha2=x.F.sha2: sha2(x.F.substring(c, 1, 1), bits))  # a weak digest
    rows = [(1, "ab"), (2, "ac"), (3, "ab"), (4, "b"), (5, "b"), (6, "ad"), (None, "ad"), (None, "ae")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in x.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest").collect()}
    assert got == {(1, 3, 2, False), (2, 2, 1, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (None, 6, 2, False), (None, None, 1, True)}


# --- SimHash -------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    k = min(3, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in ids}


def test_simhash(docs, no_docs):
    from tessera.llm.simhash_golay import near_duplicates

    texts = [(i, t) for i, t, _ in TEXTS]
    prints = {i: brute_fingerprint(t) for i, t in texts}
    ids = [i for i in prints if i is not None]
    comp = brute_components(ids, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    got = near_duplicates(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.fingerprint == f"{prints[r.doc_id]:016x}"
        if r.doc_id is not None:
            assert r.component_id == comp[r.doc_id]
    assert near_duplicates(no_docs).count() == 0


def test_simhash_by_other_shingles_and_links(docs):
    from tessera.llm.simhash_golay import near_duplicates

    def five(text):
        w = words(text)
        if not w:
            return 0
        k = min(5, len(w))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: five(t) for i, t, _ in TEXTS}
    ids = [i for i in prints if i is not None]
    for radius in (0, 3):
        comp = brute_components(ids, lambda a, b, most=radius: (prints[a] ^ prints[b]).bit_count() <= most)
        for r in near_duplicates(docs, shingle_words=5, radius=radius).collect():
            assert r.fingerprint == f"{prints[r.doc_id]:016x}"
            assert r.doc_id is None or r.component_id == comp[r.doc_id]
    with pytest.raises(ValueError):
        near_duplicates(docs, radius=4)


def test_golay_keys_meet_for_every_error_pattern():
    import numpy as np

    from tessera.llm.simhash_golay import fuzzy_keys, nearby_offsets

    table, n = nearby_offsets()
    assert n.min() == 1 and n.max() == 6
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    other = base.copy()
    for _ in range(3):
        other ^= np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)
    key_sets = []
    for fp in (base, other):
        where, keys = fuzzy_keys(fp)
        sets = [set() for _ in fp]
        for i, k in zip(where.tolist(), keys.tolist(), strict=True):
            sets[i].add(k)
        key_sets.append(sets)
    assert all(a & b for a, b in zip(*key_sets, strict=True))


def test_buckets_go_on_from_batch_to_batch():
    import numpy as np
    import pyarrow as pa

    from tessera.llm import simhash_golay as g

    rng = np.random.default_rng(9)
    key = np.sort(np.concatenate([np.full(500, 7), rng.integers(0, 60, 400)]))
    base = rng.integers(0, 1 << 62, 70)
    fp = base[key] ^ (1 << rng.integers(0, 62, len(key)))
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    keep = np.concatenate([[True], (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])
    key, fp = key[keep], fp[keep]

    def tied(size):
        batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(fp[i : i + size])], names=["key", "fp"]) for i in range(0, len(key), size))
        pairs = [(a, b) for out in g._links(batches) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        root = {x: x for x in fp.tolist()}
        for a, b in pairs:
            ra, rb = root[a], root[b]
            root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
        return root

    whole = tied(len(key))
    assert tied(1) == tied(13) == tied(100) == whole and len(set(whole.values())) < 80


@pytest.mark.parametrize("n", [300])
def test_hot_buckets_keep_their_links(monkeypatch, n):
    import numpy as np

    from tessera.llm import simhash_golay as g

    rng = np.random.default_rng(5)
    fp = np.unique(np.concatenate([rng.integers(0, 1 << 63, 4).astype(np.uint64)[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))]))

    def parts():
        root = list(range(len(fp)))
        for a, b in g._forest(fp):
            ra, rb = root[a], root[b]
            root = [min(ra, rb) if x in (ra, rb) else x for x in root]
        return root

    pairwise = parts()
    monkeypatch.setattr(g, "PAIRWISE", 2)
    assert parts() == pairwise


# --- PII -----------------------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    from tessera.llm.pii import luhn

    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def check_pii(spans_by_kind, text):
    from tessera.llm.pii import BASE, automaton, scan

    got = [f"{k}:{a}:{b}" for a, b, k in scan(text, automaton()) if k in BASE]
    assert got == brute_pii(text), text


def test_pii_against_patterns():
    import random

    rng = random.Random(11)
    alphabet = ["@", ".", "-", "+", " ", "1", "9", "25", "255", "a", "b.c", "x@y.z", "(", ")", "4493434194505928", "+1 (986) 555-2531", "1.2.3.4", "é", "_", "%"]
    for _ in range(20_000):
        check_pii(None, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))))


def test_pii_on_long_runs_in_linear_time():
    import time

    from tessera.llm.pii import automaton, scan

    anchors = automaton()
    n = 100_000
    for text in (
        "account" + " " * n + ";", "account no" + " " * n + "#" + " " * n, "password" + "\t" * n, "token=" + "a" * n, "+1" + " " * n, "1" * n, "1." * n, "a@" * n, "x@" + "b" * n, "://" * n,
        "www." * n, "account " * n, "DE12 " * n, "secret:" * n, "A" * n + "@", "1 " * n, "+1(" * n,
    ):
        began = time.time()
        scan(text, anchors)
        assert time.time() - began < 6, text[:20]
    assert scan("account" + " " * n + "AB123456", anchors) == [(n + 7, n + 15, "account")]
    assert scan("account number12345", anchors) == [(8, 19, "account")]


def test_pii_ibans_cost_no_more_than_other_cues():
    """In CPU time, beside a text of as many anchors, so that the speed of the machine doesn't matter."""
    import random
    import time

    from tessera.llm.pii import IBAN, automaton, iban_end, scan

    def took(text):
        began = time.process_time()
        scan(text, anchors)
        return time.process_time() - began

    anchors, n = automaton(), 40_000
    took("account " * n)
    assert min(took("DE12 " * n) for _ in range(3)) < 10 * min(took("account " * n) for _ in range(3))

    def holds(x):
        x = x.replace(" ", "")
        return 15 <= len(x) <= 34 and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1

    rng, valid = random.Random(4), 0
    for _ in range(4000):
        body = "".join(rng.choice("0123456789AZ") for _ in range(rng.randint(11, 30)))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        words = f"DE{check:02d}{body}"
        words = " ".join(words[i : i + 4] for i in range(0, len(words), 4)) + rng.choice(["", " X", " 12 AB", "7", " A1B2C3"])
        whole = IBAN.match(words).group()
        ends = [i for i in range(len(whole) + 1) if (i == len(whole) or whole[i] == " ") and holds(whole[:i])]
        assert iban_end(whole) == max(ends, default=0)
        valid += bool(ends)
    assert valid > 2000


def test_pii_ip_parts_with_leading_zeros():
    zeros = "0" * 30
    for text in (f"{zeros}1.2.3.4", f"1.{zeros}255.3.4", f"1.2.{zeros}256.4", "0.0.0.00000", "999.1.1.1"):
        check_pii(None, text)


def test_pii_on_the_table(docs, no_docs):
    from tessera.llm.pii import find_pii

    want = {(i, t): brute_pii(t or "") for i, t, _ in TEXTS}
    got = find_pii(docs).collect()
    assert len(got) == len(TEXTS)
    by_digest = sorted(hashlib.sha256(",".join(s).encode()).hexdigest() for s in want.values()) + [hashlib.sha256(b"").hexdigest()]
    assert sorted(r.base_sha256 for r in got) == sorted(by_digest)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1] == "email:22:47,phone:51:68" and spans[2] == ""
    assert spans[16].startswith("url:0:21,url:26:") and "secret:" in spans[16]
    assert find_pii(no_docs).count() == 0


# --- quality -------------------------------------------------------------------------------------------------


def test_quality_on_the_table(spark, docs, no_docs):
    from tessera.llm import quality_gam as q

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 17)] + [(3, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.learn(docs, labels)
    got = q.score(docs, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = q.learn(docs, labels.limit(0))
    assert {r.score for r in q.score(docs, empty).collect()} == {0.5}
    assert q.score(no_docs, model).count() == 0
    assert q.learn(no_docs, labels).offset == 0


def test_quality_finds_an_interaction():
    import numpy as np

    from tessera.llm.quality_gam import fit

    rng = np.random.default_rng(1)
    x = rng.random((6000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = fit(x[:4000], y[:4000])
    assert (((model.score(x[4000:]) > 0.5) == y[4000:]).mean()) > 0.95


def test_quality_scores_against_brute_force(spark, docs):
    """Scores by looking bins up one at a time, in a model with tables and pairs."""
    import bisect
    import math
    from collections import Counter

    import numpy as np

    from tessera.llm import quality_gam as q

    rng = np.random.default_rng(2)
    x = np.stack([np.array(q.features(" ".join(rng.choice(["the", "of", "{|#", "word", "ab.", "Xy"], int(rng.integers(1, 60)))).encode())) for _ in range(400)])
    model = q.fit(x, (x[:, q.FEATURES.index("common_words")] + 0.2 * x[:, q.FEATURES.index("symbol")] > 0.3).astype(float))
    assert model.pairs and any(t.any() for t in model.tables)

    def slow(values):
        total = model.offset + sum(table[bisect.bisect_right(edges.tolist(), v)] for edges, table, v in zip(model.edges, model.tables, values, strict=True))
        place = lambda j: bisect.bisect_right(model.pair_edges[j].tolist(), values[j])
        return 1 / (1 + math.exp(-(total + sum(table[place(i), place(k)] for i, k, table in model.pairs))))

    got = {r.doc_id: (r.score, r.predicted) for r in q.score(docs, model).collect()}
    for i, t, _ in TEXTS:
        want = slow(q.features((t or "").encode()))
        assert got[i][0] == pytest.approx(want, rel=1e-12) and got[i][1] == int(want >= 0.7)
    found = dict(zip(q.FEATURES, q.features(b"The cat. THE cat\nsat!"), strict=True))
    text, w = "The cat. THE cat\nsat!", ["The", "cat.", "THE", "cat", "sat!"]
    n = Counter(text)
    assert found["log_words"] == math.log1p(5) and found["mean_word"] == sum(map(len, w)) / 5 and found["distinct_words"] == 1.0
    assert found["upper"] == 4 / len(text) and found["newline"] == 1 / len(text) and found["capital_words"] == 2 / 5 and found["ended_lines"] == 1 / 2
    assert found["entropy"] == pytest.approx(-sum(c / len(text) * math.log2(c / len(text)) for c in n.values()))


def test_quality_learns_from_its_fold_only(spark):
    import zlib

    from tessera.llm import quality_gam as q

    rows = [(i, ("good words of the text and more " if i % 2 else "{|#< zz9 ") * (1 + i % 7)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    labels = lambda other: spark.createDataFrame([(i, (i % 2) ^ (other and i in held), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    one, two = (q.score(docs, q.learn(docs, labels(other))).orderBy("doc_id").collect() for other in (False, True))
    assert one == two and {r.doc_id for r in one if r.held_out} == held
    assert sum(r.predicted == r.doc_id % 2 for r in one if r.held_out) > 0.95 * len(held)
    twice = docs.unionByName(spark.createDataFrame([(3, "{|#< zz9 junk")], docs.schema))
    models = [q.learn(d.coalesce(1), labels(False)) for d in (twice, twice.orderBy("text"), twice.orderBy(q.F.desc("text")))]
    assert len({tuple(m.tables[0].tolist()) for m in models}) == 1


def test_quality_on_held_out_rows_of_the_tables(spark):
    from tessera.llm import registry

    sf = "/root/testdata/sf0.01"
    got = registry.op5_quality_gam(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").filter("quality is not null"), "doc_id").selectExpr("avg(int(predicted = quality))", "count(*)").first()
    assert got[1] > 50 and got[0] > 0.95


# --- mixing --------------------------------------------------------------------------------------------------


def test_mixing_on_the_table(docs, no_docs):
    from tessera.llm.mixing import mix

    documents, blocks = mix(docs, block=64)
    got = documents.collect()
    assert len(got) == len(TEXTS)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r["rank"], [r.source_size, r.target, 0, 0])
        s[2], s[3] = s[2] + r.taken, s[3] + r.size
    assert all(size == total and taken == int(target) for size, target, taken, total in by.values())
    assert abs(sum(s[1] for s in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert blocks.agg({"n_tokens": "sum"}).first()[0] == sum(r.taken for r in got)
    again, _ = mix(docs, block=64)
    assert rows_of(again) == rows_of(documents)
    assert mix(no_docs)[0].count() == 0


def test_schedule_keeps_every_prefix_near_the_targets(docs):
    from tessera.llm.mixing import mix

    _, blocks = mix(docs, block=64)
    rows = blocks.filter("rank is not null").select("slot", "rank").distinct().collect()
    n = len(rows)
    total, half = {}, {}
    for r in rows:
        total[r["rank"]] = total.get(r["rank"], 0) + 1
        half[r["rank"]] = half.get(r["rank"], 0) + (r.slot < n // 2)
    assert all(abs(half.get(k, 0) - v / 2) <= 4 + v * 0.02 for k, v in total.items())


def test_schedule_hits_every_slot_once_and_decides_what_is_taken(spark):
    from math import gcd

    from tessera.llm.mixing import lattice_step, mix, schedule

    for n in (*range(1, 300), 4096, 2 * 3 * 5 * 7 * 11 * 13, 10**12 + 39):
        g = lattice_step(n)
        assert gcd(g, n) == 1 and (n < 10 or abs(g / n - 0.618034) < 0.1)
    plan = spark.createDataFrame([("a", 1, 5000, 9000.0), ("b", 2, 700, 650.5), ("c", 3, 10, 0.0), (None, 4, 3000, 6000.0)], "source string, rank int, source_size long, target double")
    got = [(r["rank"], r.k, r.slot) for r in schedule(spark, plan, 64).collect()]
    assert sorted(x[2] for x in got) == list(range(len(got)))
    by = {}
    for rank, k, _ in sorted(got, key=lambda x: x[2]):
        assert k == by.get(rank, 0)
        by[rank] = k + 1
    assert by == {1: 79 + -(-4000 // 64), 2: -(-650 // 64), 4: 2 * 47}
    # many sources, more slots than cells and stretches, in the same one way
    docs = spark.sql("select id doc_id, concat('s', id % 5000) source, 'a b c' text from range(15000)")
    documents, blocks = mix(docs, block=1)
    rows = documents.collect()
    assert sum(r.taken for r in rows) == sum({r["rank"]: int(r.target) for r in rows}.values()) and all(r.taken <= 2 * r.size for r in rows)
    assert blocks.select("slot").distinct().count() == blocks.count()


def test_mixing_with_repeated_rows_and_ids(spark):
    from tessera.llm.mixing import mix

    rows = [(None, "n n n", "a")] * 300 + [(7, "x y", "a")] * 3000 + [(7, "other text here", "a"), (7, None, None), (8, "z " * 3000, "b")]
    documents, _ = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16)
    got = documents.collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r["rank"], [int(r.target), 0])[1] += r.taken
    assert all(goal == taken for goal, taken in by.values())
    assert len({(r["rank"], r.start) for r in got if r.size}) == sum(r.size > 0 for r in got)


# --- substring dedup -----------------------------------------------------------------------------------------


def brute_repeats(texts, window=20):
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = words(t, fold=False)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n=120):
    import random

    rng = random.Random(seed)
    pool = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(15, 90))) for _ in range(12)]
    texts = []
    for i in range(n):
        parts = [" ".join(f"u{rng.randint(0, 9)}" for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 4)):
            parts += [rng.choice(pool), " ".join(f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(0, 30)))]
        texts.append((i * 7 + 3, rng.choice([" ", "  ", "\n"]).join(parts)))
    return texts + [(10_000, "x " * 50), (10_001, "x " * 50), (2**40, texts[5][1])]


def test_substring_on_the_table(docs, no_docs):
    from tessera.llm.substring_cms import remove_repeats

    assert rows_of(remove_repeats(docs).drop("kept")) == brute_repeats([(i, t) for i, t, _ in TEXTS])
    assert remove_repeats(no_docs).count() == 0


@pytest.mark.parametrize(("seed", "fan"), [(1, 256), (2, 3)])
def test_substring_over_many_blocks_and_shards(spark, monkeypatch, seed, fan):
    from tessera.llm import common, substring_cms as s

    monkeypatch.setattr(common, "FAN", fan)  # three groups of shards: relays between
    monkeypatch.setattr(s, "block_count", lambda docs, text, size: 5)
    monkeypatch.setattr(s, "SHARD_WINDOWS", 300)
    texts = passages(seed)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert common.block_count(df) == 1
    assert rows_of(s.remove_repeats(df).drop("kept")) == brute_repeats(texts)


# --- packing -------------------------------------------------------------------------------------------------


def test_packing_on_the_table(docs, no_docs):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import pack

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in TEXTS}
    got = pack(docs).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for i, rows in by_doc.items():
        n = 2 if i == 8 else 1
        assert sum(r.length for r in rows) == n * len(ids[i])
        assert all(r.start == r.piece * 4096 for r in rows)
    assert set(by_doc) == set(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by_seq) == -(-sum(r.length for r in got) // 4096)
    assert pack(no_docs).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    import random

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.packing import Encoder

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, enc, rng = Tokenizer.from_file(path), Encoder(path), random.Random(2)
    bits = ["it's", "don't", "x", "É", "é", "é", "ΣΑΣ", "<|endoftext|>", " ", "　", "12", "3", "!!", "'s", ".", ",", "?!", "\"", "»", "A1", "<|STARTOFTEXT|>", "\u0301", "\t", "\n", " ", "  ", "\x0b", "\x1c", "\x85", "漢字", "\x01", "a\x01b", "\U0001f600", "İ", "ﬁ", "foo"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert np.frombuffer(enc([text.encode()])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_folds_after_composition_and_forgets(monkeypatch):
    """H with a line below has no composed form, h with it has one: folding first would make other ids."""
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = ["H\u0331", "aT\u0308!", "\u00c9cole\u0331.", "W\u030a###", "\u00c9\u00c8\u00d7, \u00e0\u00f7. \u00df%%%", "|> <| x<|END|>", "", " \n", "a" * 5000 + "&", "\u041c\u0438\u0440 \u043c\u0438\u0440."]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for most in (packing.CACHE_STEMS, 4):
        monkeypatch.setattr(packing, "CACHE_STEMS", most)
        enc = packing.Encoder(path)
        for _ in range(3):
            for t, ids in zip(texts, want, strict=True):
                assert np.frombuffer(enc([t.encode()])[0], "<u4").tolist() == ids, repr(t)
            assert [np.frombuffer(x, "<u4").tolist() for x in enc([t.encode() for t in texts])] == want
        assert len(enc.stems) <= most and max(map(len, enc.stems.to_pylist())) <= packing.CACHE_LENGTH


def test_encoder_stays_small_over_new_words():
    """Workers outlive the packing stage, beside the heap: what one keeps of 900,000 different words is bounded."""
    import subprocess
    import sys
    from pathlib import Path

    code = """
import re, public_tokenizers
from tessera.llm import packing
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
enc, letters, most = packing.Encoder(public_tokenizers.path(packing.VOCABULARY)), "etaoinsr", 0
before = held()
for k in range(9):
    text = " ".join("".join(letters[i >> 3 * j & 7] for j in range(7)) + "." for i in range(100_000 * k, 100_000 * (k + 1))).encode()
    for part in packing.in_parts([text[i : i + 8000] for i in range(0, len(text), 8000)], packing.PART_BYTES):
        enc(part)
    most = max(most, held())
print(most - before)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[2], capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    assert float(run.stdout) < 90, run.stdout


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_and_wastes_little(seed):
    import numpy as np

    from tessera.llm.packing import nnls, plan_packing

    rng = np.random.default_rng(seed)
    sizes = np.minimum(4096, 1 + rng.lognormal(6 + seed / 2, 1.1, 5000).astype(int))
    histogram = np.bincount(sizes, minlength=4097)
    runs = plan_packing(histogram)
    assert (np.bincount(runs[:, 0], runs[:, 2], 4097) == histogram).all()
    n = int((runs[:, 3] + runs[:, 2]).max())
    load = np.zeros(n, int)
    for size, _, many, first, at in runs.tolist():
        assert (load[first : first + many] <= 4096).all()
        load[first : first + many] += size
    assert (load <= 4096).all() and (load > 0).all()
    least = max(-(-int(sizes.sum()) // 4096), int((sizes > 2048).sum()))
    assert n <= least * 1.01 + 1
    a, x = rng.random((12, 30)), np.maximum(0, rng.standard_normal(30))
    assert np.abs(a @ nnls(a, a @ x) - a @ x).max() < 1e-6


# --- vectors -------------------------------------------------------------------------------------------------


def test_word_hashes_tell_words_apart():
    from tessera.llm import vectors as v

    long = [b"y" * n for n in (8, 9, 16, 63, 64, 65, 66, 200)]
    text = b"  ab ba ab\n\tabc " + "é ü".encode() + b" ab " + b" ".join(long)
    w = text.split()
    for got in v.word_hashes(text):
        assert len(got) == len(w)
        assert all((a == b) == (x == y) for a, x in zip(got.tolist(), w, strict=True) for b, y in zip(got.tolist(), w, strict=True))
    assert not len(v.word_hashes(b" \n ")[0]) and not len(v.word_hashes(b"")[1])
    # the same word hashes alike wherever it stands
    assert v.word_hashes(b"zzz yyyyyyyyyyyyyyyy")[0][1] == v.word_hashes(b"yyyyyyyyyyyyyyyy")[0][0]


def test_substring_keeps_words_that_cancel_out_in_polynomial_hashes(spark):
    from tessera.llm.substring_cms import remove_repeats

    one = "a"
    for _ in range(10):  # Thue-Morse words: equal under every polynomial modulo 2^64
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    common = " ".join(f"c{i}" for i in range(19))
    rows = [(1, f"{common} {one}"), (2, f"{common} {two}"), (3, f"{common} {one}")]
    got = rows_of(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept"))
    assert got == brute_repeats(rows) and [r[2] for r in got] == [0, 0, 20]


def test_substring_order_of_equal_ids(spark):
    from tessera.llm.substring_cms import remove_repeats

    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(7, f"zz {passage} x"), (7, f"aa {passage} y"), (7, f"mm {passage}")]
    results = {tuple(rows_of(remove_repeats(spark.createDataFrame(r, "doc_id long, text string").coalesce(1)))) for r in (rows, rows[::-1], rows[1:] + rows[:1])}
    assert len(results) == 1 and sorted(r[2] for r in next(iter(results))) == [0, 25, 25]


# --- vectors' near duplicates --------------------------------------------------------------------------------


def vector_rows():
    import numpy as np

    rng = np.random.default_rng(8)
    out, centre = [], rng.standard_normal((6, 16))
    for i in range(500):
        c = centre[i % 6] if i % 3 == 0 else rng.standard_normal(16)
        v = (c + rng.standard_normal(16) * 0.12).astype(np.float32).tolist()
        out.append((i, v, i % 2))
    hot = rng.standard_normal(16)
    out += [(1000 + i, (hot + rng.standard_normal(16) * 0.03).astype(np.float32).tolist(), 1) for i in range(150)]
    out += [(2000 + i, out[7][1], 1) for i in range(30)]
    out += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] * 16, 1), (3003, [1.0, None] * 8, 1), (3004, out[3][1], None), (3005, [1.0] * 3, 1), (3006, [2.0] * 3, 1), (3007, [], 0), (5, out[5][1], 1)]
    return out


def brute_vectors(rows, threshold=0.93):
    import numpy as np

    unit = []
    for _, v, label in rows:
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if ok else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in links[i])])
            changed |= low < comp[i]
            comp[i] = low
    return sorted((r[0], len(links[i]), comp[i], comp[i] == r[0]) for i, r in enumerate(rows))


def test_nn_descent_against_brute_force(spark):
    from tessera.llm.nn_descent import near_duplicate_vectors

    rows = vector_rows()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = near_duplicate_vectors(df).collect()
    assert got[0].recall == 1.0
    want = brute_vectors(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert near_duplicate_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("n", "pairs"), [(6000, 60), (3000, 1500)])
def test_nn_descent_keeps_isolated_pairs(spark, monkeypatch, n, pairs):
    import numpy as np

    from tessera.llm import nn_descent as nn

    # Small windows stand for a label that is large against them. Rare links can't be audited; many can, and are lacking.
    monkeypatch.setattr(nn, "CHUNK", 4)
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, 64))
    x[:pairs] = x[n - pairs :] + rng.standard_normal((pairs, 64)) * 0.33
    x /= np.linalg.norm(x, axis=1)[:, None]
    sims = x @ x.T
    np.fill_diagonal(sims, 0)
    links = (sims >= 0.93).sum(axis=1)
    assert links.max() == 1 and links.sum() > pairs
    got = nn.near_duplicate_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")).collect()
    lost = sum(r.n_links != links[r.vec_id] for r in got)
    assert len(got) == n and lost <= (0.01 if n == 2 * pairs else 0) * links.sum()
    if not lost:
        assert all(r.component_id == (min(r.vec_id, int(sims[r.vec_id].argmax())) if links[r.vec_id] else r.vec_id) for r in got)


def test_nn_descent_on_a_cluster_of_many_blocks(spark, monkeypatch):
    import numpy as np

    from tessera.llm import nn_descent as nn

    monkeypatch.setattr(nn, "BLOCK", 128)
    monkeypatch.setattr(nn, "AUDIT_BLOCK", 100)
    rng = np.random.default_rng(3)
    hot = rng.standard_normal(24)
    rows = [(i, (hot + rng.standard_normal(24) * (0.3 if i % 2 else 0.1)).astype(np.float32).tolist(), 1) for i in range(700)]
    rows += [(700 + i, rng.standard_normal(24).astype(np.float32).tolist(), 1) for i in range(300)]
    got = nn.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = brute_vectors(rows)
    assert max(r[1] for r in want) > 300
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want


def test_the_audit_counts_links_by_identity(spark):
    import numpy as np

    from tessera.llm import nn_descent as nn

    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((500, 16)), 2, axis=0) + rng.standard_normal((1000, 16)) * 0.01
    x /= np.linalg.norm(x, axis=1)[:, None]
    vectors = spark.createDataFrame([(i, "k", bytearray(v.tobytes()), i % 100 == 0, i % 10 == 0) for i, v in enumerate(x)], "node long, kind string, v binary, coarse boolean, fine boolean")
    true = spark.sql("select id a, id + if(id % 2 = 0, 1, -1) b from range(1000)")
    root = spark.sql("select id node, id div 2 root, false dense from range(1000)")
    assert nn._audit(vectors, root, true, 0.93) == (1.0, None)  # a hundred linked vectors can't vouch for 99 %
    assert nn._audit(vectors.withColumn("fine", nn.F.lit(True)), root, true, 0.93) == (1.0, True)
    wrong = spark.sql("select id a, (id + 2) % 1000 b from range(1000)")  # as many links, other ones
    recall, holds = nn._audit(vectors.withColumn("fine", nn.F.lit(True)), root, wrong, 0.93)
    assert recall == 0.0 and holds is False


# --- suffix merge sort ---------------------------------------------------------------------------------------


def brute_strings(texts, length):
    from collections import Counter

    bodies = [(i, (t or "").encode()) for i, t in texts]
    seen = Counter(b[p : p + length] for _, b in bodies for p in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_merge_on_the_table(docs, no_docs):
    from tessera.llm.suffix_merge import remove_repeated_strings

    short = docs.withColumn("text", docs.text.substr(1, 9000))
    got = rows_of(remove_repeated_strings(short).drop("kept"))
    assert got == brute_strings([(i, (t or "")[:9000]) for i, t, _ in TEXTS], 400)
    whole = {r.doc_id: r for r in remove_repeated_strings(docs).collect()}
    assert whole[9].n_removed == len(LONG) and whole[10].n_spans == 1
    assert remove_repeated_strings(no_docs).count() == 0


@pytest.mark.parametrize(("seed", "length", "span", "fan"), [(1, 40, 16, 256), (2, 60, 33, 3), (3, 400, 256, 2)])
def test_suffix_merge_against_brute_force(spark, monkeypatch, seed, length, span, fan):
    from tessera.llm import common, suffix_merge as s

    monkeypatch.setattr(common, "FAN", fan)  # fewer groups than shards: relays between
    monkeypatch.setattr(s, "block_count", lambda docs, text, size: 6)
    monkeypatch.setattr(s, "SHARD_BYTES", 9000)
    texts = passages(seed, 70) + [(20_000, "ab" * 700), (20_001, "xab" + "ab" * 300), (20_002, "q" * 450), (20_003, "q" * 401 + "r")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows_of(s.remove_repeated_strings(df, length=length, span=span).drop("kept")) == brute_strings(texts, length)


def test_loser_tree_merges_and_keeps_prefixes():
    import random

    from tessera.llm.suffix_merge import common_prefix, merge_runs, read_run, write_run

    rng = random.Random(4)
    for k in (1, 2, 3, 7):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        coded = [read_run(write_run([(x, b"left") for x in r])) for r in runs]
        assert [[x for x, _, _ in r] for r in coded] == runs
        merged = merge_runs(coded)
        strings = [runs[r][i] for r, i, _ in merged]
        assert strings == sorted(x for r in runs for x in r)
        assert [p for _, _, p in merged][1:] == [common_prefix(a, b) for a, b in zip(strings, strings[1:])]


# --- context-tree weighting ----------------------------------------------------------------------------------


def brute_ctw(texts, depth):
    import math
    import zlib
    from collections import Counter

    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts if i is not None} | {None: False}
    token = lambda t: [*words(t), b"\xff"]
    counts = Counter(w for i, t in texts if not held[i] for w in token(t))
    n, v = sum(counts.values()), len(counts)
    node = Counter()

    def walk(t):
        data = b"\xff" * depth + (t or "").encode().lower() + b"\xff"
        for k in range(depth, len(data)):
            prefix = 1
            for place in range(8):
                bit = data[k] >> (7 - place) & 1
                yield [(data[k - d : k], prefix) for d in range(depth + 1)], bit
                prefix = prefix << 1 | bit

    for i, t in texts:
        if not held[i]:
            for path, bit in walk(t):
                for at in path:
                    node[at, bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    nodes = {at for at, _ in node}
    pw, weight = {}, {}
    for d in range(depth, -1, -1):
        inner = Counter()
        for at in [a for a in nodes if len(a[0]) == d + 1]:
            inner[at[0][1:], at[1]] += pw[at]
        for at in [a for a in nodes if len(a[0]) == d]:
            e = kt(node[at, 0], node[at, 1])
            if d == depth:
                pw[at], weight[at] = e, 1.0
            else:
                hi, lo = max(e, inner[at]), min(e, inner[at])
                pw[at] = math.log(0.5) + hi + math.log1p(math.exp(lo - hi))
                weight[at] = math.exp(math.log(0.5) + e - pw[at])
    out = {}
    for i, t in texts:
        score = 0.0
        for path, bit in walk(t):
            p = None
            for at in reversed(path):
                a, b = node[at, 0], node[at, 1]
                if a + b:
                    own = ((b if bit else a) + 0.5) / (a + b + 1)
                    p = own if p is None else weight[at] * own + (1 - weight[at]) * p
            score += math.log10(0.5 if p is None else p)
        c = [counts[w] for w in token(t)]
        out[i] = (held[i], len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), score)
    return out


@pytest.mark.parametrize(("depth", "blocks", "fan"), [(5, 1, 256), (3, 4, 256), (4, 6, 3)])
def test_ctw_against_brute_force(spark, monkeypatch, depth, blocks, fan):
    from tessera.llm import common, ctw

    monkeypatch.setattr(common, "FAN", fan)  # fewer groups than shards: relays between
    monkeypatch.setattr(ctw, "block_count", lambda docs, text, size: blocks)
    monkeypatch.setattr(ctw, "SHARD_BYTES", (16 << 20) if blocks == 1 else 4000)
    monkeypatch.setattr(ctw, "FLUSH_WORDS", 100)
    monkeypatch.setattr(ctw, "CHUNK", 1 << 20 if blocks == 1 else 700)
    monkeypatch.setattr(ctw, "SORTED", 1 << 22 if blocks == 1 else 900)
    texts = passages(9, 40)[:40] + [(50_001, None), (50_002, ""), (50_003, "Ünï ABC abc"), (50_004, " \n"), (None, "null id")]
    got = {r.doc_id: tuple(r)[1:] for r in ctw.score(spark.createDataFrame(texts, "doc_id long, text string"), depth=depth).collect()}
    want = brute_ctw(texts, depth)
    assert set(got) == set(want)
    for i, w in want.items():
        assert got[i][:4] == w[:4]
        assert got[i][4:] == pytest.approx(w[4:], rel=1e-9)


def test_ctw_on_the_table(docs, no_docs):
    from tessera.llm.ctw import score

    got = score(docs).collect()
    want = brute_ctw([(i, (t or "")[:3000]) for i, t, _ in TEXTS if i != 8] + [(8, "same text here")] * 2, 5)
    assert len(got) == len(TEXTS) and all(r.score < 0 for r in got)
    short = {r.doc_id: tuple(r)[1:] for r in score(docs.withColumn("text", docs.text.substr(1, 3000))).collect()}
    assert all(short[i] == pytest.approx(w, rel=1e-9) for i, w in want.items())
    assert score(no_docs).count() == 0


def test_ctw_spreads_a_frequent_context():
    import numpy as np

    from tessera.llm.ctw import SPREAD, shard_of_keys

    rng = np.random.default_rng(2)
    rest = rng.integers(0, 1 << 32, 100_000, dtype=np.uint64)
    keys = np.uint64(0x6520) << np.uint64(32) | rest  # one two-byte context, depth 5
    shards, n = np.unique(shard_of_keys(keys, 500, 5), return_counts=True)
    assert SPREAD // 2 < len(shards) <= SPREAD and n.max() < 0.15 * len(keys)
    for b in range(256):  # a context of three bytes is whole
        assert len(np.unique(shard_of_keys(keys[(rest >> np.uint64(24)) == b], 500, 5))) <= 1


# --- pipeline ------------------------------------------------------------------------------------------------


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import random
    from collections import Counter

    import corpus_pipeline as p

    rng = random.Random(6)
    vocabulary = [f"{a}{b}" for a in ("re", "on", "the", "ing", "ous") for b in ("th", "nd", "ar", "el")]
    texts = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 300))) + ".", rng.choice("aab") + "x") for i in range(60)]
    texts += [(60 + i, "{|#<" * rng.randint(5, 60), "junk") for i in range(30)]
    texts += [(100 + i, texts[5][1], "ax") for i in range(4)] + [(104, texts[5][1], "ax"), (104, texts[5][1], "ax")]
    texts += [(300, texts[11][1] + " the " + texts[12][1], "ax"), (300, texts[13][1] + " one " + texts[14][1], "bx")]  # two texts with one id
    texts += [(110 + i, texts[7][1] + " th", None) for i in range(3)] + [(200, None, "ax"), (201, "", "bx"), (None, texts[9][1] + " end of it", "bx")]
    rows = [(i, t, "en", s, len(t or ""), True) for i, t, s in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in p.STAGES[:-1]:
        before, now = now.collect(), stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        now = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '')}")
        after = now.collect()
        assert after and set(after) <= set(before)
        if name == "quality classifier":
            assert {r.doc_id for r in after if r.doc_id is not None} >= set(range(60)) and not {r.doc_id for r in after} & set(range(60, 90))
        elif name == "exact dedup":
            best = {}
            for r in before:
                best[r.text or ""] = max(best.get(r.text or "", r.doc_id or -1), r.doc_id or -1)
            assert sorted((r.doc_id or -1, r.text or "") for r in after) == sorted((i, t) for t, i in best.items())
        elif name == "SimHash near-dedup":
            prints = {(r.doc_id is None, r.doc_id or 0, r.text): brute_fingerprint(r.text) for r in before}
            order = sorted(prints, key=lambda x: (x[:2], x[2] or ""))
            comp = brute_components(range(len(order)), lambda a, b: (prints[order[a]] ^ prints[order[b]]).bit_count() <= 3)
            assert sorted(str(r.doc_id) for r in after) == sorted(str(None if order[i][0] else order[i][1]) for i, c in comp.items() if i == c)
            assert sum(r.doc_id == 300 for r in after) == 2
        else:
            sizes = Counter()
            for r in before:
                sizes[r.source] += len(words(r.text))
            total, got = 1.5 * sum(sizes.values()), Counter()
            for r in after:
                got[r.source] += len(words(r.text))
            assert max(Counter((r.doc_id, r.text) for r in after).values()) <= 2
            assert abs(sum(got.values()) - total) <= 300 * len(sizes) and all(got[s] <= 2 * sizes[s] for s in sizes)
    packed = p.pack(spark, now, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in after)
    assert {r.doc_id for r in packed} >= {300}
    assert sorted(map(repr, (tuple(r)[:5] for r in p.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, (tuple(r)[:5] for r in packed)))
