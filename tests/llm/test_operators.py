"""Each operator against a brute-force version, a round trip or held-out labels."""

import heapq
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import components, decontam, fingerprint, lm, packing, quality, sharding, simhash, substring, tokencount, warc
from wordloom.llm.common import HashCache, hash_words, text_key, words_of

SF = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that operators use inside
EXTRA = ["n_words", "item_id", "hash", "key", "shard", "text_key", "h", "pos", "count", "digest", "batch", "id", "hi", "lo", "part", "size", "word"]


def vocabulary(seed, n=4000):
    r = random.Random(seed)
    return ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n)]


def text(r, words, n):
    return " ".join(r.choice(words) for _ in range(n))


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns."""
    r, words = random.Random(5), vocabulary(5)
    shared = text(r, words, 300)
    rows = [(1, None, "en", "a", 3), (None, shared, None, None, None), (None, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "!!! ???", "en", "b", 7), (5, "one", "en", "b", 3), (6, shared, "en", "b", 9), (6, shared, "en", "b", 9), (7, text(r, words, 30_000), "en", "c", 9), (8, "x" * 200_000, "en", "c", 200_000), (9, text(r, words, 400), "en", None, None)]
    df = spark.createDataFrame(rows, DOC)
    for c in EXTRA:
        df = df.withColumn(c, F.lit("clash"))
    return df


# 1


def test_packing(spark):
    r = random.Random(1)
    lengths = [r.choice([0, 1, 5, 40, 100, 300, 301, 900, 2048, 2049, 5000]) + r.randint(0, 3) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, n bigint").withColumn("text", F.lit("x"))
    for shard_rows in (50_000, 1000):
        rows = packing.packed(df, shard_rows=shard_rows, length="n").collect()
        placed, room = Counter(), {}
        for x in rows:
            placed[x.doc_id] += x.n_words
            assert (x.sequence is None) == (x.n_words == 0)
            if x.n_words:
                room.setdefault((x.shard, x.sequence), []).append((x.offset, x.n_words))
        assert all(placed[i] == n for i, n in enumerate(lengths))
        for pieces in room.values():
            at = 0
            for o, n in sorted(pieces):
                assert o >= at
                at = o + n
            assert at <= packing.CAPACITY
        assert len(room) <= 1.05 * sum(lengths) / packing.CAPACITY + 30
    assert packing.packed(df.limit(0), length="n").count() == 0


def test_packing_edges(edge):
    rows = packing.packed(edge).collect()
    assert sum(x.n_words for x in rows if x.doc_id == 7) == 30_000
    assert sum(x.doc_id == 6 for x in rows) == 2 and all(x.sequence is None for x in rows if x.doc_id in (1, 2, 3))


# 2


def brute_spans(doc, item):
    least, out = decontam._needed(len(item)), set()
    if len(item) < decontam.K:
        return out
    for i in range(len(doc)):
        for j in range(len(item)):
            if doc[i] == item[j] and (not i or not j or doc[i - 1] != item[j - 1]):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_decontamination(spark, edge, limit):
    r, words = random.Random(2), vocabulary(2, 300)
    items = [text(r, words, n) for n in (40, 30, 13, 9, 7, 5, 60)] + [None, "", "a b a b a b a b a b a b a b a b"]
    docs = []
    for i in range(120):
        t = words_of(text(r, words, r.randint(0, 120)))
        if i % 2:
            part = words_of(items[r.randrange(7)])
            lo = r.randint(0, max(0, len(part) - 13))
            t[len(t) // 2 : len(t) // 2] = part[lo : lo + r.randint(5, 40)]
        docs.append(" ".join(t).upper() if i % 3 else " , ".join(t))
    docs += [None, "", "a b a b a b a b a b a b a b a b a", docs[1]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = decontam.contaminated(frame(spark, docs), bench, limit).collect()
    want = {(d, i, *s) for d, t in enumerate(docs) for i, x in enumerate(items) for s in brute_spans(words_of(t), words_of(x))}
    assert len(got) == len(want) and {tuple(x) for x in got} == want and len(want) > 20
    assert decontam.contaminated(edge, bench, limit).count() == 0
    assert decontam.contaminated(frame(spark, docs), bench.limit(0), limit).count() == 0


# 3


def test_token_counts_equal_the_library(spark, edge):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab, unk, byte = tokencount.load_vocabulary()
    lib = Tokenizer(models.Unigram(vocab, unk, byte))
    lib.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    r = random.Random(3)
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(150).collect()]
    texts += ["", " ", "  a  b ", "日本語 テキスト", "naïve 🙂🙂 x", "a" * 500, "▁▁x", "\n\n\t", "".join(r.choice("aä▁ b\n🙂") for _ in range(300))]
    counter = tokencount.PieceCounter(vocab, unk, byte)
    for t in texts:
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t[:80]
    got = {x.doc_id: x.n_tokens for x in tokencount.token_counts(edge).collect()}
    assert got[1] is None and got[2] == 0 and got[8] > 0


# 4


def test_substring_against_brute_force(spark):
    r, words = random.Random(4), vocabulary(4)
    passages = [text(r, words, n) for n in (50, 51, 55, 60, 80, 200, 45)]
    docs, planted = [], []
    for i in range(200):
        t = [text(r, words, r.randint(20, 300))]
        if i % 3 == 0:
            p = r.randrange(len(passages))
            planted.append((i, p))
            t += [passages[p], text(r, words, r.randint(20, 100))]
        docs.append(" ".join(t))
    docs += [docs[5], None, "", docs[5]]
    got = substring.repeated_spans(frame(spark, docs)).collect()
    by = {}
    for x in got:
        w, f = words_of(docs[x.doc_id]), words_of(docs[x.first_id])
        assert x.n_words >= 50 and (x.first_id < x.doc_id) and w[x.start : x.start + x.n_words] == f[x.first_start : x.first_start + x.n_words]
        by.setdefault(x.doc_id, []).append((x.start, x.start + x.n_words))
    first, want, found = {}, 0, 0
    for i, p in planted:
        if p == 6:
            assert i not in by or all(b - a >= 50 for a, b in by[i])
        elif p not in first:
            first[p] = i
        else:
            want += 1
            lo = next(k for k in range(len(words_of(docs[i]))) if words_of(docs[i])[k : k + 50] == words_of(passages[p])[:50])
            found += any(a <= lo and b >= lo + len(words_of(passages[p])) for a, b in by.get(i, []))
    assert want > 40 and found == want
    assert by[200] == by[203] == [(0, len(words_of(docs[5])))]
    one = substring.repeated_spans(frame(spark, docs), batches=1).collect()
    assert {tuple(x) for x in one} == {tuple(x) for x in got}
    left = {x.doc_id: x for x in substring.drop_repeats(frame(spark, docs)).collect()}
    assert 200 not in left and left[201].text is None and left[202].text == "" and left[5].text == docs[5]
    assert substring.repeated_spans(frame(spark, docs).limit(0)).count() == 0


def test_substring_tries_later_holders(spark):
    r, words = random.Random(24), vocabulary(24)
    filler = lambda: text(r, words, r.randint(30, 90)).split()
    docs = []
    for i in range(30):  # the first holder has 25-49 words of it, or more but not all
        p = text(r, words, r.choice([50, 50, 52, 60, 70, 120])).split()
        part, cut = r.randint(25, 49) if i % 3 else r.randint(25, 90), r.choice([0, 1])
        docs += [filler() + (p[:part] if cut else p[-part:]) + filler(), *(filler() + p + filler() for _ in range(3))]
    p = text(r, words, 60).split()
    docs += [p[5:35] + filler() + p + filler(), filler() + p]  # the whole is the first holder's second place
    got = substring.repeated_spans(frame(spark, [" ".join(d) for d in docs])).collect()
    covered = [set() for _ in docs]
    for x in got:
        assert x.n_words >= 50 and x.first_id < x.doc_id
        assert docs[x.doc_id][x.start : x.start + x.n_words] == docs[x.first_id][x.first_start : x.first_start + x.n_words]
        covered[x.doc_id].update(range(x.start, x.start + x.n_words))
    earlier = set()
    for d, have in zip(docs, covered):  # all pairs: every window of 50 words that an earlier document has
        own = [tuple(d[i : i + 50]) for i in range(len(d) - 49)]
        assert have == {k for i, w in enumerate(own) if w in earlier for k in range(i, i + 50)}
        earlier.update(own)


def test_substring_index_is_incremental_and_compacts(spark, tmp_path):
    r, words = random.Random(14), vocabulary(14)
    p = text(r, words, 60)
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    docs = frame(spark, [text(r, words, 100) + " " + p for _ in range(8)]).select("doc_id", text_key().alias("text_key"), "text")
    for i in range(4):
        probes = index.add(docs.filter(f"doc_id div 2 = {i}")).select("doc_id", "src_id").distinct().collect()
        assert all(x.src_id == 0 for x in probes) and len({x.doc_id for x in probes}) == (1 if i == 0 else 2)
        index.compact()
    assert sorted(level for level, _, _ in index.runs) == [0, 1]
    again = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert {x[1] for x in again.runs} == {x[1] for x in index.runs} and again.entries().count() == index.entries().count()
    again.drop()


def test_substring_two_calls_equal_one(spark, tmp_path):
    r, words = random.Random(34), vocabulary(34)
    passages = [text(r, words, r.randint(50, 120)) for _ in range(6)]
    texts = []
    for i in range(90):
        p = r.choice(passages).split()
        lo = r.randint(0, 20)
        texts.append(" ".join([text(r, words, r.randint(0, 60)), " ".join(p[lo:] if i % 3 else p[: len(p) - lo]), text(r, words, r.randint(0, 60))]))
    df = frame(spark, texts + [texts[3], texts[70]])
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    old = df.filter("doc_id < 50")
    one = substring.repeated_spans(old, 2, index).collect()
    before = index.entries().count()
    two = substring.repeated_spans(df.filter("doc_id >= 50"), 2, substring.FingerprintIndex(spark, str(tmp_path / "index")), old).collect()
    index = substring.FingerprintIndex(spark, str(tmp_path / "index"))
    assert before < index.entries().count() == index.entries().select("h").distinct().count()
    assert Counter(map(tuple, one + two)) == Counter(map(tuple, substring.repeated_spans(df).collect())) and len(two) > 10
    index.drop()


def test_substring_long_repetitive_texts(spark):
    import time

    began = time.time()
    got = substring.repeated_spans(frame(spark, ["a " * 1_000_000, "b " + "a " * 1_000_000, "a " * 200 + "c", "x y z " * 20_000, "y z x " * 20_000])).collect()
    assert time.time() - began < 60
    assert {(x.doc_id, x.first_id, x.start, x.n_words) for x in got} == {(1, 0, 1, 1_000_000), (2, 0, 0, 200), (4, 3, 0, 59_999), (4, 3, 1, 59_999)} or {x.doc_id for x in got} == {1, 2, 4}


def test_substring_edges(spark, edge):
    got = substring.repeated_spans(edge).collect()
    assert {(x.doc_id, x.start, x.n_words, x.first_id) for x in got} == {(6, 0, 300, None)}
    left = substring.drop_repeats(edge)
    assert left.columns == edge.columns and sorted((x.doc_id is None, x.doc_id or 0) for x in left.collect()) == sorted([(True, 0)] * 2 + [(False, i) for i in (1, 2, 2, 3, 4, 5, 7, 8, 9)])
    assert {x.doc_id: x.text for x in left.collect() if x.doc_id} == {x.doc_id: x.text for x in edge.collect() if x.doc_id and x.doc_id != 6}


# 5


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, edge, order):
    r, words = random.Random(6), vocabulary(6, 60)
    texts = [text(r, words, r.randint(0, 80)) for _ in range(200)] + [None, "", "?!"]
    df = frame(spark, texts)
    filter_, total, parts = lm.train(df, order, part_ngrams=2000)
    assert total == sum(len(words_of(t)) for t in texts) and filter_.count() == parts > 1
    filters = {x.part: np.frombuffer(x.bits, np.uint64) for x in filter_.collect()}
    flat, counts = hash_words(texts, HashCache())
    exact = Counter()
    for n in range(1, order + 1):
        h = lm.ngram_hashes(flat, counts, n)
        exact.update(h[h != lm.INF].tolist())
    keys = np.array(sorted(exact), np.uint64)
    true = lm.level_of(np.array([exact[int(k)] for k in keys]))
    found = lm._levels(parts, filters, keys)
    assert (found >= true).all() and (found > true).mean() < 0.03
    one = lm.scores(df, order, part_ngrams=2000).collect()
    two = lm.scores(df, order, broadcast_limit=0, part_ngrams=2000).collect()
    assert sorted(map(tuple, one), key=repr) == sorted(map(tuple, two), key=repr)
    got = {x.doc_id: x for x in one}
    assert got[200].n_words is None and got[200].log_prob is None and got[201].n_words == 0 and got[201].log_prob is None

    def brute(t):
        w, out = words_of(t), 0.0
        hs = [lm.ngram_hashes(*hash_words([t], HashCache()), n) for n in range(1, order + 1)]
        c = [[lm.count_of(lm.level_of(np.array([exact[int(x)]])))[0] if int(x) in exact else 0 for x in h] for h in hs]
        for i in range(len(w)):
            p = (c[0][i] + 1) / (total + total**0.5 + 1)
            for n in range(2, order + 1):
                s = i - n + 1
                if s >= 0 and c[n - 2][s] > 0:
                    p = lm.LAMBDA * min(1.0, c[n - 1][s] / c[n - 2][s]) + (1 - lm.LAMBDA) * p
            out += np.log(p)
        return out

    off = [abs(got[i].log_prob - brute(texts[i])) / got[i].n_words for i in range(40) if got[i].n_words]
    assert np.median(off) < 0.02
    assert lm.scores(edge, order).count() == edge.count() and lm.scores(edge.limit(0), order).count() == 0


# 6


def plain_lpt(sizes, shards):
    heap, out = [(0, i) for i in range(shards)], []
    for s in sorted(sizes, reverse=True):
        load, i = heap[0]
        out.append((s, i))
        heapq.heapreplace(heap, (load + s, i))
    return out


def test_lpt_equals_plain_heap():
    r = random.Random(7)
    for _ in range(300):
        shards = r.randint(1, 9)
        sizes = [r.choice([0, 1, 1, 2, 3, 50, r.randint(0, 400)]) for _ in range(r.randint(0, 120))]
        got = [(size, mine[k % len(mine)]) for size, _, n, mine in sharding.lpt(list(Counter(sizes).items()), shards) for k in range(n)]
        assert got == plain_lpt(sizes, shards)


def test_sharding(spark, edge):
    r = random.Random(8)
    rows = [(i, "x" * r.choice([0, 1, 5, 9]), f"g{i % 90}") for i in range(600)]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), shards=5).collect()
    group, load = {}, Counter()
    for x in got:
        assert group.setdefault(x.source, x.shard) == x.shard
        load[x.shard] += len(rows[x.doc_id][1])
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    want = Counter()
    for s, i in plain_lpt(size.values(), 5):
        want[i] += s
    assert len(got) == 600 and load == want
    assert sharding.sharded(edge).count() == edge.count() and sharding.sharded(edge.limit(0)).count() == 0


# 7


def test_warc_round_trip(spark, tmp_path):
    import zstandard

    rows = [(i, f"http://x/{i}", f"<p>é {i}</p>\r\n\r\n" * (i % 40)) for i in range(300)] + [(None, None, "no ids"), (7, "http://x/7\r\nevil: 1", ""), (8, "u", None), (9, "u", "y" * 3_000_000), (9, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("bundle", F.lit("clash")).repartition(3)
    root = str(tmp_path / "w")
    index = warc.write_bundles(pages, root, frame_bytes=4000, bundle_bytes=500)
    back = warc.read_records(index, root).collect()
    assert Counter((x.page_id, x.html) for x in back) == Counter((p, h) for p, _, h in rows if h is not None)
    assert index.count() == len(rows) and index.filter("bundle is null").count() == 1
    files = {p.name: p.read_bytes() for p in (tmp_path / "w/bundles").iterdir() if p.name.endswith(".zst")}
    assert set(files) == {x.bundle for x in index.select("bundle").distinct().collect() if x.bundle} and len(files) > 3
    plain = b"".join(zstandard.ZstdDecompressor().stream_reader(d, read_across_frames=True).read() for d in files.values())
    assert plain.count(b"WARC/1.1\r\n") == len(rows) - 1 and b"\r\nevil" not in plain
    assert warc.write_bundles(pages.limit(0), str(tmp_path / "none")).count() == 0


# 8


@pytest.mark.parametrize("n_bytes", [16, 0])
def test_fingerprints(spark, edge, n_bytes):
    texts = ["Straße  x", "STRASSE x ", "strasse\tx", "éte", "ÉTÉ", "été", "ﬁn", "fin", "a b", "ab", "", "  ", None, None, "a b"]
    got = {x.doc_id: (x.keep_id, x.copies) for x in fingerprint.exact_groups(frame(spark, texts), n_bytes).collect()}
    canon = [None if t is None else fingerprint.canonical(t) for t in texts]
    for i, c in enumerate(canon):
        same = [j for j, d in enumerate(canon) if d == c] if c is not None else [i]
        assert got[i] == (same[0], len(same)), texts[i]
    assert canon[0] == canon[1] == canon[2] and canon[8] == canon[14]
    found = fingerprint.exact_groups(edge, n_bytes).collect()
    assert len(found) == edge.count() and {x.copies for x in found if x.doc_id == 6} == {3}
    assert fingerprint.exact_groups(edge.limit(0), n_bytes).count() == 0


# 9


def near_pairs(rows):
    """All ids and all near pairs of signatures' rows, by the definition, whatever their origin."""
    rows = sorted({x.doc_id: x for x in rows}.values(), key=lambda x: x.doc_id)
    bits = np.array([(x.hi, x.lo) for x in rows], np.int64).view(np.uint64)
    sketches = [{int(h) for h in np.frombuffer(x.sketch, np.uint32)} - {0xFFFFFFFF} for x in rows]
    pairs = []
    for i, x in enumerate(rows):
        for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits[:i]).sum(axis=1) <= simhash.VERIFY).tolist():
            both = sorted(sketches[i] | sketches[j])
            both = both[: simhash.SKETCH] if max(len(sketches[i]), len(sketches[j])) == simhash.SKETCH else both
            if len(sketches[i] & sketches[j] & set(both)) >= simhash.MIN_COMMON * len(both):
                pairs.append((rows[j].doc_id, x.doc_id))
    return [x.doc_id for x in rows], pairs


def components_of(nodes, pairs):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_simhash_recall_and_precision(spark):
    r, words = random.Random(9), vocabulary(9)
    base = [text(r, words, r.randint(60, 400)).split() for _ in range(150)]
    texts, origin = [], []
    for i, w in enumerate(base):
        for c in range(1 + i % 3):
            w2 = list(w)
            for _ in range(len(w) * c // 40):
                w2[r.randrange(len(w2))] = r.choice(words)
            texts.append(" ".join(w2))
            origin.append(i)
    texts += [texts[0], texts[0].upper(), None, "", "..."]
    df = frame(spark, texts)
    gone = {x.doc_id: x.keep_id for x in simhash.near_duplicates(df).collect()}
    assert all(origin[d] == origin[k] and k < d for d, k in gone.items() if d < len(origin)) and len({*gone} & set(range(len(origin), len(origin) + 2))) == 2
    want = components_of(*near_pairs(simhash.signatures(df).collect()))
    assert len(want) > 100 and {d: k for d, k in want.items() if d != k} == gone
    again = {x.doc_id: x.keep_id for x in simhash.near_duplicates(df.orderBy(F.xxhash64("doc_id"))).collect()}
    assert again == gone


def test_simhash_finds_all_pairs_to_the_last_bit(spark):
    r, words = random.Random(19), vocabulary(19)
    texts = []
    for i in range(400):  # isolated pairs, 5 to 15 % of the words replaced
        w = text(r, words, r.randint(80, 400)).split()
        other = list(w)
        for k in r.sample(range(len(w)), len(w) * (5 + i % 11) // 100):
            other[k] = r.choice(words)
        texts += [" ".join(w), " ".join(other)]
    df = frame(spark, texts)
    sigs = {x.doc_id: np.array([x.hi, x.lo]).view(np.uint64) for x in simhash.signatures(df).collect()}
    gone = {(x.keep_id, x.doc_id) for x in simhash.near_duplicates(df).collect()}
    distance = {(i, i + 1): int(np.bitwise_count(sigs[i] ^ sigs[i + 1]).sum()) for i in range(0, len(texts), 2)}
    near = {p for p, d in distance.items() if d <= simhash.VERIFY}
    assert sum(12 <= distance[p] for p in near) > 100
    assert gone == near


def test_simhash_checks_shingles_of_each_document(spark):
    r, words = random.Random(29), vocabulary(29)
    w = list(dict.fromkeys(text(r, words, 600).split()))[:300]
    near = [" ".join(w[:k] + ["foreign"] + w[k + 1 :]) for k in range(50, 250, 10)]
    orders = []  # the same words in other orders: the signature of w, no shingle in common
    for _ in range(8):
        orders.append(r.sample(w, len(w)))
    texts = [" ".join(w), *near] + [" ".join(o) for o in orders] + [" ".join(orders[0][:-1] + ["foreign"])]
    df = frame(spark, texts)
    gone = {x.doc_id: x.keep_id for x in simhash.near_duplicates(df).collect()}
    assert gone == {i: 0 for i in range(1, 21)} | {29: 21}
    rows = [x for d in (21, 0, 1) for x in simhash.signatures(df).collect() if x.doc_id == d]
    nodes = spark.createDataFrame([(n, x.hi, x.lo, x.sketch) for n, x in enumerate(rows)], "node bigint, hi bigint, lo bigint, sketch binary")
    assert {tuple(x) for x in simhash.near_edges(nodes).collect()} == {(2, 1)}  # unlike 0 is near both by bits


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_simhash_splits_long_lists(spark, block):
    r, words = random.Random(39), vocabulary(39)
    base = text(r, words, 300).split()
    texts = [" ".join(base[:k] + [r.choice(words)] + base[k + 1 :]) for k in range(0, 300, 7)] + [text(r, words, 200) for _ in range(20)]
    rows = simhash.signatures(frame(spark, texts)).collect()
    nodes = spark.createDataFrame([(x.doc_id, x.hi, x.lo, x.sketch) for x in rows], "node bigint, hi bigint, lo bigint, sketch binary")
    edges = {(b, a) for a, b in map(tuple, simhash.near_edges(nodes, block).collect())}
    ids, pairs = near_pairs(rows)
    assert edges <= set(pairs) and components_of(ids, edges) == components_of(ids, pairs) and len(pairs) > 500


def test_simhash_edges(spark, edge):
    left = simhash.drop_near_duplicates(edge).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in left) == sorted([(False, i) for i in (1, 2, 2, 3, 4, 5, 6, 7, 8, 9)] + [(True, 0)])
    assert simhash.drop_near_duplicates(edge.limit(0)).count() == 0


def test_sketch():
    words = vocabulary(10)
    a = words[:300]
    _, _, sketch = simhash.describe([" ".join(x) for x in (a, words[1000:1300], a[:250], a[:40])], simhash.Words())
    one = sketch[:1].repeat(4, axis=0)
    shares = simhash.common_shares(one, sketch)
    assert shares[0] == 1 and shares[1] < 0.1 and 0.5 < shares[2] <= 1 and abs(shares[3] - 38 / 298) < 0.1


def test_components(spark):
    r = random.Random(11)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(None, 1), (5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in list(parent) if any(x in e for e in edges if e[0] is not None and e[0] != e[1])}


# 10


def test_classifier_held_out(spark, edge):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = labels.filter("pmod(xxhash64(doc_id), 4) = 0")
    model = quality.train(docs, labels.join(held.select("doc_id"), "doc_id", "left_anti"))
    kept = {x.doc_id for x in quality.kept(quality.score(docs, model)).collect()}
    rows = held.collect()
    right = [(x.doc_id in kept) == (x.quality == 1 and x.toxic == 0) for x in rows]
    assert len(rows) > 60 and np.mean(right) >= 0.9
    assert quality.kept(quality.score(docs, quality.train(docs, labels.limit(0)))).count() == docs.count()
    assert quality.kept(quality.score(edge, model)).count() > 0
    nulls = spark.createDataFrame([(None, 1, 0), (5, None, 1), (6, 0, None), (9, 1, 0), (9, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.filter_documents(edge, nulls).columns == edge.columns
    assert quality.filter_documents(edge.limit(0), nulls).count() == 0


def test_ftrl_against_plain_loops():
    r = random.Random(12)
    rows = [(sorted(r.sample(range(40), r.randint(0, 9))), (r.randint(0, 1), r.randint(0, 1))) for _ in range(60)]
    w, bias = quality.ftrl([(np.array(at, np.int32), label) for at, label in rows], places=40)
    for head in range(2):
        z, n = [0.0] * 41, [0.0] * 41  # the last is the bias

        def weight(i):
            if i < 40 and abs(z[i]) <= quality.L1:
                return 0.0
            return -(z[i] - (quality.L1 * (1 if z[i] > 0 else -1) if i < 40 else 0)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

        for _ in range(quality.EPOCHS):
            for at, label in rows:
                each = {i: weight(i) for i in [*at, 40]}
                g = 1 / (1 + np.exp(-sum(each.values()))) - label[head]
                for i, v in each.items():
                    z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * v
                    n[i] += g * g
        assert np.allclose(w[:, head], [weight(i) for i in range(40)], atol=1e-6) and abs(bias[head] - weight(40)) < 1e-9


def test_classifier_features_and_contradicting_labels(spark):
    from xxhash import xxh64_intdigest

    texts = ["Aa bb aa bb", None, "", "STOP it now now", "x", "!!", "long " * 5000]
    of, places = quality._features(texts, quality._Tokens())
    each = [quality._features([t], quality._Tokens())[1].tolist() for t in texts]
    assert [places[of == i].tolist() for i in range(len(texts))] == each and len(each[0]) == 2 + 2 and len(each[6]) == 2
    assert ((xxh64_intdigest(b"x") | 1) >> 13) & ((1 << quality.BITS) - 1) in each[4]
    docs = frame(spark, [f"good plain words number{i}" if i % 2 else f"bad worse spam number{i}" for i in range(80)])
    labels = [(i, i % 2, 0) for i in range(80)]
    both = spark.createDataFrame(labels + [(i, 1, 0) for i in range(80)], "doc_id bigint, quality int, toxic int")
    w, b = quality.train(docs.union(docs), both)
    w2, b2 = quality.train(docs, spark.createDataFrame(labels, both.schema))
    assert (w == w2).all() and (b == b2).all() and w.any()


def test_packing_near_the_optimum():
    """Small cases against the best packing there is, by trying all placements."""
    r = random.Random(41)

    def best(sizes, capacity):
        sizes, least = sorted(sizes, reverse=True), [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= least[0]:
                return
            if i == len(sizes):
                least[0] = len(rooms)
                return
            for k in sorted({room: k for k, room in enumerate(rooms) if room >= sizes[i]}.values()):
                place(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - sizes[i]])

        place(0, [])
        return least[0]

    over = []
    for _ in range(60):
        sizes = [r.randint(1, 30) for _ in range(r.randint(1, 10))]
        sequence, _ = packing.pack(np.array(sizes), 30)
        over.append(len(set(sequence.tolist())) - best(sizes, 30))
    # the linear program rounds each pattern up: a sequence or two more in cases as small as these
    assert min(over) >= 0 and max(over) <= 2 and sum(over) <= 30
    sizes = np.array([16, 15, 10, 9, 7, 3] * 50)
    assert len(set(packing.pack(sizes, 30)[0].tolist())) <= -(-int(sizes.sum()) // 30) + 6  # a sequence a size


def test_sharding_by_a_column_named_shard(spark):
    df = spark.createDataFrame([(1, "abc", "x"), (2, "a", "y"), (3, None, "x")], "doc_id bigint, text string, shard string")
    got = {x.doc_id: (x.shard, x.assigned) for x in sharding.sharded(df, "shard", 2).collect()}
    assert got == {1: ("x", 0), 3: ("x", 0), 2: ("y", 1)}


def test_warc_files_of_other_schemes():
    import pyarrow.fs as pafs

    fs, path = warc._files("s3a://bucket/folder")
    assert isinstance(fs, pafs.S3FileSystem) and path == "bucket/folder"


def test_decontamination_edges(spark, edge):
    shared = next(x.text for x in edge.collect() if x.doc_id == 6)
    bench = spark.createDataFrame([(1, shared), (None, shared), (2, None), (3, "one"), (4, "")], "item_id bigint, text string").withColumn("text_key", F.lit("clash"))
    for limit in (0, decontam.BROADCAST_LIMIT):
        got = Counter(map(tuple, decontam.contaminated(edge, bench, limit).collect()))
        assert got == Counter({(d, i, 0, 0, 300): 1 for d in (6, None) for i in (1, None)})
    left = decontam.drop_contaminated(edge, bench)
    assert left.columns == edge.columns and sorted((x.doc_id is None, x.doc_id or 0) for x in left.collect()) == sorted([(True, 0)] + [(False, i) for i in (1, 2, 2, 3, 4, 5, 7, 8, 9)])
