"""The training-data operators against brute force, round trips and held-out rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, chat, common, dart_minhash, decontaminate, langid, line_dedup, quality, secrets, token_store, toxicity

#: With columns whose names operators might use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, f long, words string, __no string, lines_gone long, key string, row string, k long, h long"
CLASH = (1, "clash", "no", 77, "key", "row", 5, 6)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, copies, repeated rows and clashing columns."""
    base = "The quick brown fox jumps over the lazy dog while eleven tired sailors sing about the sea and the stars above them"
    texts = [None, "", "   ", base, base, base + " now", "x" * 200_000, base.replace("sailors", "sailor"), "one\ntwo\n\nthree", "<|endoftext|> a  b\t\n c"]
    rows = [(k, t, None if k % 3 == 0 else "en", None, None, *CLASH) for k, t in enumerate(texts)] + [(None, base, "en", None, 1, *CLASH), (3, base, "en", None, 1, *CLASH)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


ALPHABET = [*" \n\t\x0b\x1c\x85\xa0'ss'tabcABCéñ漢字1²_.,!?$̀😀", "<|endoftext|>", "  ", "\n\n", " \n", "'ll", "ΑΣ"]


def fuzz(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choices(ALPHABET, k=draw.randint(0, 14))) for _ in range(n)]


def test_op3_is_the_library(odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path, generation=40)
    texts = fuzz(3000) + ["", "\u0378\n\t x", "a" * 50_000]
    for t, together in zip(texts, own.encode_all(texts), strict=True):
        ids = whole.encode(t, add_special_tokens=False).ids
        back = whole.decode(ids, skip_special_tokens=False)
        assert own.encode(t) == ids and own.decode(ids) == back
        assert own.digest(together) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    rows = bpe.bpe_round_trip(odd, path).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (0, 1)} == {0}
    assert bpe.bpe_round_trip(empty, path).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, path), path)
    assert sorted((r["text"] for r in back.collect())) == sorted(r["text"] or "" for r in odd.collect())


def test_op3_cuts_where_no_token_reaches_over():
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, own = Tokenizer.from_file(path), bpe.ForcedBoundaryBPE(path)
    pairs = [(x, y) for x in "abcdefghijklmnopqrstuvwxyzäé漢" for y in "abcdefghijklmnopqrstuvwxyzäé漢"]
    cut = [x + y for x, y in pairs if own.cuts[256 * x.encode()[-1] + y.encode()[0]]]
    assert cut
    for t in cut:
        assert own.encode(f"in{t}on {t}{t}") == whole.encode(f"in{t}on {t}{t}", add_special_tokens=False).ids


def test_op5_reads_back_what_the_library_encodes(odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    own = token_store.PieceEncoder(path, "<u2", generation=30)
    assert own.plain
    for t in fuzz(3000, 2):
        assert np.frombuffer(own(t), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids
    store = token_store.write_store(odd, path, keys_per_bucket=4)
    rows = token_store.read_store(store, store["listing"]).orderBy("start").collect()
    digests = {r["start"]: r["ids_crc32"] for r in token_store.read_store(store, store["listing"], digest=True).collect()}
    source = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    start = 0
    for r, (_, _, t) in zip(rows, source, strict=True):
        want = whole.encode(t, add_special_tokens=False).ids + [2]
        assert (r["start"], r["ids"]) == (start, want)
        assert digests[start] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    unknown = odd.sparkSession.createDataFrame([(999, 0)], "doc_id long, ordinal long")
    assert token_store.locate(store, unknown).count() == 0
    none = token_store.write_store(empty, path)
    assert token_store.read_store(none, none["listing"]).count() == 0


def test_op5_a_key_over_several_shards_is_numbered_through(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(7, f"text number {k % 40}") for k in range(200)] + [(1, "first"), (9, "last"), (None, "none"), (None, "nothing")]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path)
    found = token_store.read_store(store, store["listing"]).toPandas()
    sevens = found[found.doc_id == 7].sort_values("start")
    assert sevens.ordinal.tolist() == list(range(200))
    assert token_store.locate(store, store["listing"]).where("doc_id = 7").select("shard").distinct().count() > 1
    assert found.sort_values("start").start.tolist() == [0, *np.cumsum(found.sort_values("start").n_tokens)[:-1]]


def test_op5_point_lookups_read_a_few_blocks():
    from pyarrow import BufferReader

    draw = np.random.default_rng(2)
    h, step = draw.integers(0, 2**63, (2, 50_000)).astype(np.uint64)
    keys = pd.DataFrame({"h": h.view(np.int64), "step": step.view(np.int64), "shard": 3, "at": np.arange(50_000), "start": np.arange(50_000) * 2, "n": 5})
    data = token_store._index_bytes(keys)
    one, whole = token_store.IndexBucket(BufferReader(data)), token_store.IndexBucket(BufferReader(data)).load()
    for k in range(0, 50_000, 997):
        before = one.reads
        (there,), entry = one.get(h[k : k + 1], step[k : k + 1])
        assert there and entry["at"][0] == k and one.reads - before <= len(one.blocks) + 1
    there, entries = whole.get(h, step)
    assert there.all() and (entries["at"] == np.arange(50_000)).all()
    strange = draw.integers(0, 2**63, (2, 300)).astype(np.uint64)
    assert not whole.get(*strange)[0].any() and not one.get(*strange)[0].any()


def test_perfect_hash_is_minimal():
    draw = np.random.default_rng(1)
    h, step = draw.integers(0, 2**63, (2, 5000)).astype(np.uint64)
    assert sorted(token_store.PerfectHash.build(h, step).slots(h, step)) == list(range(5000))


def brute_lines(docs, least=10):
    def close(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < least:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    seen, out = [], {}
    for k, t in docs:
        kept = []
        for line in t.split("\n"):
            if line.strip(" \t\r\x0b\x0c"):
                if not any(close(line, s) for s in seen):
                    kept.append(line)
                seen.append(line)
            else:
                kept.append(line)
        out[k] = "\n".join(kept)
    return out


def test_op1_against_brute_force(spark, odd, empty, monkeypatch):
    draw = random.Random(3)
    lines = ["".join(draw.choices("abcd ", k=draw.randint(1, 40))) for _ in range(40)] + ["", "  ", "x", "ab"]

    def edited(s):
        if not s.strip():
            return s
        i, kind = draw.randrange(len(s)), draw.randrange(4)
        return (s, s[:i] + s[i + 1 :], s[:i] + draw.choice("abxy") + s[i:], s[:i] + draw.choice("abxy") + s[i + 1 :])[kind]

    docs = [(k, "\n".join(edited(edited(draw.choice(lines))) if draw.random() < 0.5 else edited(draw.choice(lines)) for _ in range(6))) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (common.BROADCAST_BYTES, 0):
        monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df, most=most: common.broadcast_if_small(df, most))
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
        assert got == brute_lines(docs)
    out = line_dedup.dedup_lines(odd, count="gone")
    assert out.count() == odd.count() and out.columns == [*odd.columns, "gone"]
    assert {r["lines_gone"] for r in out.collect()} == {77} and {r["__no"] for r in out.collect()} == {"no"}
    assert sorted(line_dedup.dedup_lines(odd).columns) == sorted(odd.columns)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op1_long_lines(spark):
    long = "".join(random.Random(1).choices("abc", k=60_000))
    rows = [(0, long), (1, long[:500] + long[501:]), (2, "y" + long[2:])]
    got = {r["doc_id"]: r["lines_gone"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0}


def test_op10_against_brute_force(spark, odd, empty):
    draw = random.Random(4)
    word = lambda: "".join(draw.choices("abcdefgh", k=5))
    docs = []
    for k in range(25):
        w = [word() for _ in range(150)]
        docs.append(w)
        for _ in range(draw.randrange(4)):
            v = list(w)
            for _ in range(draw.randint(0, 3)):
                v[draw.randrange(150)] = word()
            docs.append(v)
    draw.shuffle(docs)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df).collect()}
    assert got == {k: find(k) for k in range(len(docs))}
    weighted = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df, counted=True).collect()}
    assert weighted == got  # no shingle occurs twice here
    out = {(r["doc_id"], r["class_id"]) for r in dart_minhash.near_duplicates(odd).collect()}
    assert {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3), (None, 3)} <= out
    firsts = dart_minhash.first_of_each_group(odd)
    assert firsts.where("doc_id = 3").count() == 1 and firsts.columns == odd.columns
    assert dart_minhash.near_duplicates(empty).count() == 0


def linked(sets, threshold=0.8):
    """The least member of each component of sets that are near, by brute force over those that share an element."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for e in s:
            holders[e].append(k)
    shared = collections.Counter()
    for own in holders.values():
        shared.update(itertools.combinations(own, 2))
    for (a, b), n in shared.items():
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [find(k) for k in range(len(sets))]


def test_op10_loses_no_link_among_thousands(spark):
    draw = random.Random(14)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    docs = []
    for k in range(420):
        w = [word() for _ in range(draw.randint(30, 60))]
        for _ in range(draw.choice((1, 1, 2, 5, 40))):  # copies near the threshold on either side
            v = list(w)
            for _ in range(draw.choice((0, 1, 1, 2))):
                v[draw.randrange(len(v))] = word()
            docs.append(v)
    common_part = [word() for _ in range(40)]
    docs += [common_part + [word() for _ in range(12)] for _ in range(700)]  # alike in three quarters: no links, and crowded buckets
    draw.shuffle(docs)
    assert len(docs) >= 5000
    want = linked([{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs])
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(df).collect()}
    assert got == dict(enumerate(want))


def test_op10_registered_query_against_brute_force(spark):
    d = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    sets = []
    for t in d.text.fillna(""):
        w = re.findall(r"\w+", t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    want = {d.doc_id.iloc[k]: d.doc_id.iloc[r] for k, r in enumerate(linked(sets))}
    assert {r["doc_id"]: r["class_id"] for r in dart_minhash.op10_near_duplicates(spark, "/root/testdata/sf0.01").collect()} == want


def test_the_class_in_the_middle_asks_and_two_classes_meet_once(spark):
    words = dart_minhash.PARITY // 64
    rows = [("a", 1, [3, 4, 5]), ("b", 9, [3, 4, 5]), ("c", 5, [4, 5]), ("d", 2, [5])]
    placed = spark.createDataFrame([(e, bytearray(c.encode()), bytearray(c.encode()), [0] * words + [10], w, own) for c, w, own in rows for e in own], "e long, class binary, root binary, parity array<long>, weight long, prefix array<long>")
    mains = dart_minhash._mains(placed, "e")
    assert {r["e"]: bytes(r["first"]) for r in mains.collect()} == {3: b"b", 4: b"b", 5: b"b"}
    listed = placed.join(mains, "e").withColumn("outside", F.col("root") != F.col("main")).drop("main", "first", "weight")
    asking = listed.where("outside").select("e", F.col("class").alias("b"), F.col("root").alias("root_b"), F.col("parity").alias("parity_b"), F.col("prefix").alias("prefix_b"), "n")
    met = sorted(bytes(r["a"]) + bytes(r["b"]) for r in dart_minhash._pairs(listed, asking, "e", 0.8, once=True).collect())
    assert met == [b"ab", b"ac", b"ad", b"bc", b"bd", b"cd"]


def test_near_copies_at_the_threshold_are_compared_with_those_in_the_middle(spark, monkeypatch):
    """A large group of copies with up to four words changed: pairs compared in proportion to its members, met once each, and no link lost."""
    draw = np.random.default_rng(11)
    base = [f"w{k}" for k in range(146)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in draw.choice(146, i % 5, replace=False):
            words[at] = f"x{i}y{at}"
        texts.append(" ".join(words))
    sets = [dart_minhash.Shingler()(t)[0] for t in texts]
    root = list(range(300))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(300):
        for j in range(i):
            if dart_minhash.similarity(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    met, pairs_of = [], dart_minhash._pairs

    def counted(*args, **kw):
        pairs = pairs_of(*args, **kw)
        met.append((pairs.count(), pairs.distinct().count()))
        return pairs

    monkeypatch.setattr(dart_minhash, "_pairs", counted)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(300)}
    assert all(n == distinct for n, distinct in met) and sum(n for n, _ in met) <= 3 * 300, met


def test_op10_lists_and_links_carry_what_they_ask_for_and_tables_go_when_read(spark, monkeypatch):
    """Texts alike in three quarters, which share bands and many elements and are no links, and a few near copies."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    shared_part = [word() for _ in range(52)]
    docs = [shared_part + [word() for _ in range(8)] for _ in range(200)]
    for k in range(20):
        docs += [docs[k][:-1] + [word()] for _ in range(2)]
    want = linked([{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs])
    lists, ends, live, peak, firsts = [], [], {}, [], []
    pairs_of, links_of, write, drop = dart_minhash._pairs, dart_minhash._links, dart_minhash.written, dart_minhash.discard

    def pairs(members, asking, by, threshold, once=False):
        if once:
            lists.extend(members.select("e", "prefix", "root").collect())
        return pairs_of(members, asking, by, threshold, once)

    def links(met, sets, threshold):
        ends.append((sets.count(), met.select(F.explode(F.array("a", "b"))).distinct().count()))
        return links_of(met, sets, threshold)

    def written(df, label):
        out = write(df, label)
        live[out._written_to] = sum(f.stat().st_size for f in Path(out._written_to.removeprefix("file:")).glob("*.parquet"))
        firsts.append(live[out._written_to])
        peak.append(sum(live.values()))
        return out

    def discard(*tables):
        drop(*tables)
        for t in tables:
            live.pop(getattr(t, "_written_to", None), None)

    for name, f in (("_pairs", pairs), ("_links", links), ("written", written), ("discard", discard)):
        monkeypatch.setattr(dart_minhash, name, f)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want))
    assert lists and all(r["prefix"][-1] == r["e"] for r in lists)
    roots = collections.defaultdict(set)
    for r in lists:
        roots[r["e"]].add(bytes(r["root"]))
    assert all(len(found) > 1 for found in roots.values())
    assert ends and all(n == of for n, of in ends)
    # With the signatures, the first table, all that is kept at any time.
    assert max(peak) < 4 * firsts[0], (max(peak), firsts)


def test_darts_estimate_weighted_similarity():
    dart, draw = dart_minhash.DartMinHash(400), np.random.default_rng(5)
    ids = draw.integers(0, 2**63, 300).astype(np.uint64)
    x, y = draw.uniform(0.2, 3, 300), draw.uniform(0.2, 3, 300)
    agree = (dart.signature(ids, x) == dart.signature(ids, y)).mean()
    assert abs(agree - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.1


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_op4_against_brute_force(spark, odd, empty):
    draw = random.Random(6)
    word = lambda: draw.choice(["a", "b", "The", "É", "x1"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((12, 10, 3, 1, 25))] + [(7, None), (8, "!!")]
    docs = [(k, " ".join(word() for _ in range(draw.randint(0, 30))) + " " + (draw.choice(items)[1] or "")) for k in range(60)] + [(60, None), (60, "other"), (60, "other"), (None, items[1][1])]
    windows = collections.defaultdict(set)
    for k, t in items:
        w = re.findall(WORD, low(t))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(k))
    want = []
    for k, t in docs:
        w = re.findall(WORD, low(t))
        hit, named = set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= {*range(i, i + len(g))}
                    named |= own
        want.append((str(k), len(w), len(hit), ",".join(sorted(named))))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(str(r["doc_id"]), r["n_words"], r["n_hit"], ",".join(r["items"])) for r in decontaminate.contamination(d, b).collect()]
    assert sorted(got) == sorted(want)
    assert decontaminate.contamination(odd, b).count() == odd.count()
    assert decontaminate.contamination(empty, b).count() == 0
    left = decontaminate.without_contamination(odd, b.limit(0))
    assert left.count() == odd.count() and left.columns == odd.columns


def test_op4_a_long_text_of_one_term(spark):
    b = spark.createDataFrame([(1, "a"), (2, "a a b"), (3, "b a a a")], "item_id long, text string")
    d = spark.createDataFrame([(1, "a " * 20_000), (2, "a " * 20_000 + "b " + "a " * 2)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.contamination(d, b).collect()}
    assert (rows[1]["n_hit"], rows[1]["items"], rows[2]["n_hit"], rows[2]["items"]) == (20_000, ["1"], 20_003, ["1", "2"])


def test_op4_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "alpha " + "x " * 50 + "beta")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "beta alpha"), (2, "beta unheard alpha")], "item_id long, text string")
    assert {(r["doc_id"], r["item"]) for r in decontaminate.proximity_matches(d, b).collect()} == {(1, "1"), (1, "2")}


def test_op4_proximity_against_brute_force(spark):
    draw = random.Random(16)
    texts = [" ".join(draw.choices("abcdefghijklmnop", weights=range(1, 17), k=draw.randint(0, 120))) for _ in range(40)]
    items = [" ".join(draw.choices("abcdefghijklmnopxyz", k=n)) for n in (1, 2, 3, 4, 6, 9)]
    count = collections.Counter(w for t in texts for w in t.split())
    want = set()
    for i, item in enumerate(items):
        rare = sorted({w for w in item.split() if count[w]}, key=lambda w: (count[w], w))[:4]
        for k, t in enumerate(texts):
            w = t.split()
            for p in range(len(w) if rare else 0):
                if w[p] == rare[0] and all(r in w[max(0, p - 19) : p + 20] for r in rare):
                    want.add((k, str(i), p))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.proximity_matches(d, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {tuple(r) for r in got} == want and want


def test_op7_round_trip(spark):
    hard = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x", "a<|", "<", "|>", "", None, "<|im_start|>user\nhi<|im_end|>\n"]
    rows = [(k // 3, k, r, t) for k, (r, t) in enumerate(itertools.product(["user", "assistant", "a\\nb", "a\nb", "<|", None], hard))] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    want = collections.defaultdict(list)
    for c, _, r, t in rows:
        want[c].append((r or "", t or ""))
    assert back == want
    for r in out.collect():
        said = [chat_text for chat_text in (r["formatted"][s["start"] : s["end"]] for s in r["loss_spans"])]
        assert [re.sub(r"<\\(\\*)\|", r"<\1|", x) for x in said] == [t for role, t in want[r["conv_id"]] if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_op7_digests_what_the_loss_mask_covers(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    kept = chat.format_conversations
    said = lambda: {r["conv_id"]: (r["loss_chars"], r["loss_sha256"]) for r in chat.op7_chat_format(spark, d).collect()}
    right = said()
    own = "<|im_end|><|im_start|>assistant ok"
    assert right[-1] == (len(own), hashlib.sha256(own.encode()).hexdigest())
    shifted = F.transform("loss_spans", lambda s: F.struct((s["start"] - 1).alias("start"), s["end"].alias("end")))
    monkeypatch.setattr(chat, "format_conversations", lambda rows: kept(rows).withColumn("loss_spans", shifted))
    assert all(v[0] > right[k][0] for k, v in said().items() if right[k][0])


def test_op7_ties_repeats_clashes_and_long_conversations(spark):
    rows = [(1, 0, "user", "b", 1, "x"), (1, 0, "user", "a", 1, "x"), (1, 0, "user", "a", 1, "x"), (1, None, "assistant", "z", 1, "x")]
    rows += [(2, k, "assistant" if k % 2 else "user", f"<|im_end|>{k}" * 30, 1, "x") for k in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, no long, key string")
    back = {r["conv_id"]: r for r in chat.format_conversations(df).select("conv_id", "n_turns", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_texts(F.col("formatted"), F.col("loss_spans")).alias("said")).collect()}
    assert [tuple(t) for t in back[1]["turns"]] == [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert back[2]["n_turns"] == 3000 and back[2]["said"] == [f"<|im_end|>{k}" * 30 for k in range(1, 3000, 2)]


def test_op8_base_patterns_and_models(odd, empty):
    t = "password = 'abcdef12' AKIA" + "A1" * 10 + " " + "0a" * 14 + " token:abc ſecret=aaaaaaaa KEY api_key=\"Zz9+/=\""
    assert [k for _, k, _ in secrets.base_spans(t)] == [0, 1, 2, 0]
    models = secrets.train(["plain words in ordinary sentences with some_identifiers and readable_names_here " * 5])
    assert models.score("kJ8sPq2ZxV7wLm4TnB9rYc3D") > models.threshold > models.score("readable_names_and_ordinary_words")
    rows = secrets.find_secrets(odd, models).collect()
    assert len(rows) == odd.count() and {r["spans"] for r in rows if r["doc_id"] in (0, 1)} == {""}
    assert secrets.find_secrets(empty, models).count() == 0


def test_op8_registered_query_against_brute_force(spark):
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in secrets.op8_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(d.doc_id)
    for k, t in zip(d.doc_id, d.text.fillna("")):
        found = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t, re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 20]
        found = sorted(found + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 24])
        joined = ",".join(f"{secrets.KINDS[kind]}:{s}:{e}" for s, kind, e in found)
        assert rows[k]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (rows[k]["n_assign"], rows[k]["n_access"], rows[k]["n_hex"]) == tuple(sum(x[1] == n for x in found) for n in range(3))
        assert set(joined.split(",")) <= set(rows[k]["spans"].split(","))


def test_op8_numbers_are_no_secrets_and_keys_of_any_length_of_text_are():
    draw = random.Random(15)
    models = secrets.train(pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.fillna("").tolist())
    key = "".join(draw.choices(secrets.ALPHABET[:62], k=32))
    parts = [f"password=abcdef{k} {draw.randrange(10**15, 10**16)} the" for k in range(20_000)]
    found = secrets.spans(f"{key} " + " ".join(parts) + f" {key}", models)
    assert [s for s in found if s[1] == 3] == [(0, 3, 32), (found[-1][2] - 32, 3, found[-1][2])] and len(found) == 20_002


def test_op8_keys_among_the_ordinary_sample_hide_no_others():
    draw = random.Random(12)
    sets = ["abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef", secrets.ALPHABET[:62]]
    key = lambda chars, n: "".join(draw.choices(chars, k=n))
    plain = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").text.fillna("").tolist()
    for chars in sets:
        models = secrets.train(plain + [f"see {key(chars, 20 if len(chars) == 16 else 40)} there" for _ in range(60)])
        for other in sets:
            for n in (16, 20, 32, 40):
                assert sum(models.score(key(other, n)) > models.threshold for _ in range(100)) >= 95
        assert not any(k == 3 for t in plain for _, k, _ in secrets.spans(t, models))


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = collections.Counter(zip(w, w[1:], w[2:]))
    twice = {k + j for k in range(len(w) - 2) if g[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)


def test_op9_against_brute_force(spark, odd, empty):
    draw = random.Random(8)
    texts = ["".join(draw.choices(["a", "b ", " ", "\n", "#", "é\t", "\x0b", " "], k=draw.randint(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in quality.measure(df, ("doc_id",)).collect():
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(texts[r["doc_id"]])
    labels = spark.createDataFrame([(3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert quality.quality_verdicts(odd, labels).count() == odd.count()
    kept = {r["doc_id"] for r in quality.quality_verdicts(odd, labels).where("kept").collect()}
    assert {r["doc_id"] for r in quality.quality_filter(odd, labels).collect()} == kept
    assert quality.quality_filter(odd, labels).columns == odd.columns
    assert quality.quality_verdicts(empty, labels).count() == 0


def test_op9_verdicts(spark):
    clean = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{clean} x{k}", "en") for k in range(400)] + [(900, "too short", "en"), (901, "a b c " * 40, "en"), (902, None, None), (903, clean + " #" * 40, "en"), (904, clean + " #" * 40, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(400)] + [(900, 1), (903, 0), (903, None)], "doc_id long, quality int")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_verdicts(docs, labels).collect()}
    assert all(got[k] == (False, True) for k in range(400))
    assert got[900] == got[901] == got[902] == (True, False)
    assert got[903] == (False, False) and got[904] == (False, True)  # nothing is proven for the other language
    # Copies and repeated rows are one trial: four hundred rows of one text prove no level.
    same = spark.createDataFrame([(k % 100, clean, "en") for k in range(400)] + [(903, clean + " #" * 40, "en")], "doc_id long, text string, lang string")
    assert quality.quality_verdicts(same, labels).where("kept").count() == 401


def test_op9_registered_query_measures_every_document(spark):
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in quality.op9_quality_rules(spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(d.doc_id)
    for k, t in zip(d.doc_id, d.text.fillna("")):
        want = brute_quality(t)
        assert tuple(rows[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert rows[k]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (rows[k]["base_failed"] and rows[k]["kept"])


def test_exact_binomial_bound():
    import math

    want = sum(math.comb(200, j) * 0.03**j * 0.97 ** (200 - j) for j in range(4))
    assert quality.binomial_tail(3, 200, 0.03) == pytest.approx(want)
    rows = [{"stratum": "a", "good": 1000, **{f"rejected_{k}": 0 if k < 4 else 200 for k in range(quality.LEVELS)}}, {"stratum": "b", "good": 10, **{f"rejected_{k}": 0 for k in range(quality.LEVELS)}}]
    assert quality.choose_levels(rows, 0.02, 0.05) == {"a": 3}


def test_op6_held_out_accuracy(spark, empty):
    d = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.001").toPandas().merge(d, on="doc_id")
    held = out[out.held_out]
    assert set(held.doc_id) == {i for i in d.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}
    assert (held.lang_pred == held.lang).mean() > 0.95 and out.score.between(0, 1).all()
    model = langid.LanguageModel([], np.zeros((langid.BUCKETS + 1, 0)), np.ones(langid.BUCKETS))
    assert model.predict("text") == ("und", 0.0)
    assert langid.train(empty).predict("some text") == ("und", 0.0)


def test_op6_odd_rows_and_rare_languages(spark, odd, empty):
    draw = random.Random(17)
    letters = ["abcdefg", "hijklmn", "opqrstu", "vwxyzäö", "αβγδεζη"]
    rows = [(k, " ".join("".join(draw.choices(letters[n], k=5)) for _ in range(30)), f"l{n}") for k, n in enumerate([0] * 400 + [1] * 200 + [2] * 30 + [3] * 12 + [4] * 6)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_docs=60, least_docs=20)
    assert model.languages == ["l0", "l1", "l2", "l3", "l4"]
    for n, own in enumerate(letters):
        assert model.predict(" ".join("".join(draw.choices(own, k=5)) for _ in range(20)))[0] == f"l{n}"
    out = langid.predict_language(odd, model).collect()
    assert len(out) == odd.count() and {(r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (0, 1, 2)} == {("und", 0.0)}
    assert all(r["lang_pred"] in model.languages and 0 <= r["score"] <= 1 for r in out if r["doc_id"] not in (0, 1, 2))
    assert langid.predict_language(empty, model).count() == 0


def test_op2_finds_disguised_words(spark, odd, empty):
    draw = random.Random(9)
    plain = ["".join(draw.choices(["the", "an", "ing", "re", "on", "st", "ea"], k=5)) for _ in range(3000)]
    docs = []
    for k in range(400):
        d = [[draw.choice(plain) for _ in range(12)] for _ in range(5)]
        if k % 4 == 0:
            d[draw.randrange(5)].append(draw.choice(["zorgol", "quimbat"]))
        docs.append((d, int(k % 4 == 0)))
    machine = toxicity.train(docs)
    p = lambda w: float(machine.probability(machine.margins([w]))[0])
    assert min(map(p, ("zorgol", "quimbat", "zor*gol", "z-o-r-g-o-l", "q.u.i.m.b.a.t"[:11]))) > max(map(p, plain[:50]))
    rows = toxicity.score_toxicity(odd, machine).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, machine).count() == 0 and toxicity.train([]) is None and toxicity.train(docs[:2]) is None


def test_op2_witnesses_are_words_of_sentences():
    worth = {"zorgol": 3.0, "quimbat": 2.0}
    parts = [["the", "zorgol", "quimbat"], ["(quimbat)", "on"], ["the", "on"], ["quimbat"]]
    assert toxicity.put_forward(parts, worth, 10) == [("quimbat", 2), ("zorgol", 1)]
    assert [sorted(x) for x in toxicity.sentences("One two. Three!\n\nFour")] == [["one", "two."], ["three!"], ["four"]]


def test_op2_a_long_word_is_scored_in_parts():
    machine = toxicity.SubsequenceMachine(np.zeros(toxicity.SIZE), 0.5)
    sizes = [len(of) for _, of in toxicity.windows(["x" * 400_000, "short"])]
    assert max(sizes) == toxicity.BATCH and machine.margins(["x" * 400_000, "short"]).tolist() == [0.5, 0.5]


def test_op2_reads_enough_for_what_one_toxic_document_in_two_hundred_holds(spark):
    docs = [(k, f"plain words {k} " + ("stone" if k % 2 else "quimbat" if k % 400 == 0 else "zorgol"), k % 2 ^ 1) for k in range(10_000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    sample = common.sampled(rows.select("doc_id", "text"), "doc_id", "text", "x", toxicity.Training.per_class, toxicity.Training.chars, groups=rows.selectExpr("doc_id AS group_key", "toxic AS g")).collect()
    toxic, clean = ([set(r["t"].split()) for r in sample if r["g"] == label] for label in (1, 0))
    assert len(toxic) == len(clean) == 3000
    beginnings = toxicity.strong_beginnings(toxic, clean, toxicity.Training.least)
    assert {"quimbat", "zorgol"} <= set(beginnings)


def test_op2_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    out = toxicity.op2_toxicity(spark, d).toPandas()
    labels, texts = pd.read_parquet(f"{d}/labels.parquet"), pd.read_parquet(f"{d}/documents.parquet")
    held = out[out.held_out].merge(labels, on="doc_id").merge(texts, on="doc_id")
    assert set(out[out.held_out].doc_id) == {i for i in texts.doc_id if zlib.crc32(str(i).encode()) % 3 == 1}
    # A third of the labelled documents hold no insult at all: what can be found are those that do.
    insulting = held.text.str.lower().str.contains("trash|clown|scum|idiot|worthless|pathetic|moron|loser|disgusting|stupid")
    assert (held[insulting].predicted == 1).all() and held[~insulting & (held.toxic == 0)].predicted.mean() < 0.02


def test_samples_are_bounded_and_hold_repeated_rows_once(spark):
    rows = [(k, f"text {k}", "a") for k in range(500)] + [(1, "again", "a")] * 500 + [(k, "x" * 400, "b") for k in range(50)] + [(1, None, "c"), (None, "t", "c"), (2, "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r["g"], r["t"]) for r in common.sampled(df, "doc_id", "text", "x", 100, 10_000, F.col("lang")).collect()]
    assert collections.Counter(g for g, _ in got) == {"a": 100, "b": 25, "c": 2} and got.count(("a", "again")) <= 1


def test_pipeline_keeps_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns, name
    assert hashlib.sha256(b"").hexdigest() not in {r["decoded_sha256"] for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()}


def test_pipeline_stages_take_odd_and_empty_tables(spark, odd, empty):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, d)
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            rows = out.collect()
            assert len(rows) <= docs.count() and {r["lines_gone"] for r in rows} <= {77}, name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()
    left = corpus_pipeline.line_dedup(spark, odd, d)
    assert {r["doc_id"] for r in left.collect()} >= {0, 1, 2, 3}
    assert corpus_pipeline.near_dedup(spark, odd, d).where("doc_id IN (0, 1, 2)").count() == 3


def test_broadcasts_are_measured(spark):
    small = common.written(spark.range(10).selectExpr("id", "repeat('x', 1000) AS s", "array('a', s) AS t", "struct(id, s) AS u"), "small")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(common.broadcast_if_small(small)) and not hinted(common.broadcast_if_small(small, 10_000))
