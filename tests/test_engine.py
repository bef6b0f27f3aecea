import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.api import BACKENDS, Backend, Index, IndexKind, SearchEngine, StorageError
from wordloom.functions import codec
from wordloom.functions.text import index_terms, query_tokens, tokens
from wordloom.operators import filters, index, prepare
from wordloom.sources import json_posts
from wordloom.sources.schema import Schema, SchemaError, load_schema

POST = "doc_id bigint, title string, url string, meta string, body string"


def build(spark, rows, kind="exact", stop=None):
    posts = spark.createDataFrame([(i, t, f"/{i}", "", b) for i, (t, b) in enumerate(rows)], POST)
    engine = SearchEngine().with_index_kind(kind)
    return (engine if stop is None else engine.with_stopwords(stop)).build(posts)


def scores(index, query, n=10):
    return [(r.title, r.score) for r in index.search(query, n).collect()]


@pytest.mark.parametrize(
    "title, body, query, exact, xor",
    [
        ("Rust Guide", None, "rust", 3, 4),
        ("Rust Guide", None, "rus", 2, 2),
        ("Rust Guide", None, "rust rust", 6, 8),
        ("Rust Guide", "rustic", "rust", 4, 4),
        ("Rust Guide", "rustic", "rus", 3, 2),
        ("The Guide", None, "the", 3, 3),
        ("Other", "theory", "the", 1, 0),
        ("First", "program programming", "prog", 1, 0),
        ("Go", "golang", "go", 3, 4),
        ("Go!", "go", "go!", 3, 4),
        ("Rust Programming", None, "ru", 0, 0),
        ("Any", "words", "12 -- !", 0, 0),
        ("Any", "words", "", 0, 0),
    ],
)
def test_scores(spark, title, body, query, exact, xor):
    assert scores(build(spark, [(title, body)], stop=("the",)), query) == [(title, exact)] * bool(exact)
    found = scores(build(spark, [(title, body)], "xor", ("the",)), query)
    assert found == [(title, xor)] * bool(xor) or dict(found).get(title, 0) > xor  # a false positive may add


def test_order_ties_and_limits(spark):
    i = build(spark, [("Rustacean Guide", None), ("Rust Guide", None), ("Rust Guide", "x")])
    assert [r.doc_id for r in i.search("rust", 10).collect()] == [1, 2, 0]
    assert i.search("rust", 0).count() == 0
    assert i.search("rust", 1_000_000_000).count() == 3
    many = build(spark, [(f"Document {n}", f"prefix{chr(97 + n % 26)}x") for n in range(40)])
    assert many.search("pre", 100).count() == 40


def test_search_many_equals_single(spark):
    i = build(spark, [("Alpha beta", "gamma gammaray"), ("Beta", "alphabet"), ("Delta", None)])
    q = spark.createDataFrame([(0, "alpha"), (1, "gam beta beta"), (2, "none"), (3, None)], "query_id int, query string")
    many = {}
    for r in i.search_many(q, 10).collect():
        many.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for k, text in ((0, "alpha"), (1, "gam beta beta"), (2, "none")):
        assert sorted(many.get(k, [])) == sorted((r.rank, r.doc_id, r.score) for r in i.search(text, 10).collect())


SCRIPTS = ["हिन्दी भाषा", "ภาษาไทย ดี", "اللغة العربيّة", "ΟΔΟΣ Straße İstanbul", "日本語 テキスト", "naïve e\u0301te\u0301"]


def test_single_equals_batch_in_all_scripts(spark):
    rows = [("Title", s) for s in SCRIPTS]
    exact, xor = build(spark, rows), build(spark, rows, "xor8")
    many = {}
    for r in exact.search_many(spark.createDataFrame(list(enumerate(SCRIPTS)), "query_id int, query string"), 10).collect():
        many.setdefault(r.query_id, []).append((r.rank, r.doc_id, r.score))
    for k, query in enumerate(SCRIPTS):
        one = [(r.rank, r.doc_id, r.score) for r in exact.search(query, 10).collect()]
        assert sorted(one) == sorted(many[k]) and k in [d for _, d, _ in one]
        assert k in [r.doc_id for r in xor.search(query, 10).collect()]


def test_default_stop_words(spark):
    from wordloom.functions.stopwords import ENGLISH

    assert len(ENGLISH) == 771 and {"ain't", "again", "first"} <= set(ENGLISH)
    assert scores(build(spark, [("Title", "again first lighthouse")]), "again") == []


def test_load_checks_what_was_saved(spark, tmp_path):
    build(spark, [("One", "alpha"), ("Two", "beta")]).save(str(tmp_path / "i"))
    docs = spark.read.parquet(str(tmp_path / "i/docs")).collect()
    spark.createDataFrame(docs[:1], spark.read.parquet(str(tmp_path / "i/docs")).schema).write.mode("overwrite").parquet(str(tmp_path / "i/docs"))
    with pytest.raises(StorageError, match="1 documents of 2"):
        Index.load(spark, str(tmp_path / "i"))
    assert Index.load(spark, str(tmp_path / "i"), check=False).count() == 1


@pytest.mark.parametrize("kind", ["exact", "xor8"])
def test_save_and_load(spark, tmp_path, kind):
    i = build(spark, [("Rust Guide", "observability details"), ("Other", "programming")], kind)
    i.save(str(tmp_path / "i"))
    j = Index.load(spark, str(tmp_path / "i"))
    assert scores(j, "observability") == scores(i, "observability") != []
    with pytest.raises(StorageError):
        Index.load(spark, str(tmp_path / "none"))


def test_stop_words_markup_and_unicode(spark):
    def terms(text, stop=("the",)):
        return set(spark.range(1).select(index_terms([F.lit(text)], stop).alias("t")).first().t)

    assert terms("The [Link](http://target.example) <b>bold</b>&amp;x don't don’t Über_snake42") == {"link", "bold", "x", "don't", "don", "t", "über", "snake"}
    assert terms("the", ()) == {"the"}
    assert spark.range(1).select(tokens(F.lit(None).cast("string")).alias("t")).first().t == []
    assert query_tokens(spark, "Don't STOP-me 4 Été") == ["don't", "stop", "me", "été"]


def test_json_cli_and_schema(spark, tmp_path, capsys):
    from wordloom.cli import main

    posts = [{"name": "Bluetooth Speaker", "text": "waterproof, loud", "tags": ["x", 1, None, "y"], "link": "/a", "price": 42}, {"text": "no lighthouse", "link": "/b", "price": None}]
    (tmp_path / "posts.json").write_text(json.dumps(posts))
    (tmp_path / "wordloom.toml").write_text('[schema]\nindexed_fields = ["name", "text", "tags"]\nmetadata_fields = ["price"]\nurl_field = "link"\n')
    main(["index", str(tmp_path / "posts.json"), str(tmp_path / "out")], spark)
    main(["search", str(tmp_path / "out"), "waterp", "-N", "1"], spark)
    assert capsys.readouterr().out.strip() == "Title: Bluetooth Speaker, Url: /a, Meta: 42"
    main(["search", str(tmp_path / "out"), "no", "lighthouse", "--json"], spark)
    assert json.loads(capsys.readouterr().out)[0] == {"title": "/b", "url": "/b", "meta": ""}
    body = {r.url: r.body for r in prepare.project(json_posts.read_fields(spark, str(tmp_path / "posts.json")), load_schema(str(tmp_path))).collect()}
    assert body == {"/a": "Bluetooth Speaker waterproof, loud x y", "/b": "no lighthouse"}


def test_schema_errors(tmp_path):
    assert load_schema(str(tmp_path)) == Schema(("title", "body"), (), "url")
    for bad in (dict(indexed_fields=()), dict(url_field=""), dict(indexed_fields=("a", "url"))):
        with pytest.raises(SchemaError):
            Schema(**bad)
    for text in ("not toml [", "[other]\n"):
        (tmp_path / "wordloom.toml").write_text(text)
        with pytest.raises(SchemaError):
            load_schema(str(tmp_path))


def test_typed_posts(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"title": "T", "url": "/t", "meta": {"b": "2", "a": "1"}, "other": 3}, {"title": "U", "url": "/u"}]))
    posts = json_posts.read_typed(spark, str(tmp_path / "p.json"))
    found = {r.url: r for r in SearchEngine().prepare(posts).collect()}
    assert found["/t"].meta == '{"a":"1","b":"2"}' and found["/u"].meta == "" and {r.doc_id for r in found.values()} == {0, 1}
    (tmp_path / "q.json").write_text(json.dumps([{"title": "T"}]))
    with pytest.raises(Exception, match="no url"):
        json_posts.read_typed(spark, str(tmp_path / "q.json")).collect()


def test_last_wins_backend_and_kinds(spark):
    rows = spark.createDataFrame([(0, "T", "/t", "finch"), (1, "T", "/t", "heron")], "pos int, title string, url string, body string")
    assert [r.body for r in SearchEngine().prepare(rows).collect()] == ["heron"]
    seen = []

    class Recorder(Backend):
        def build(self, docs):
            seen.extend(docs.first().terms)
            return BACKENDS[IndexKind.EXACT].build(docs)

    SearchEngine().build_with(rows, Recorder())
    assert {"heron"} <= set(seen)
    assert str(IndexKind.parse("xor")) == "xor8"
    with pytest.raises(ValueError):
        IndexKind.parse("b-tree")
    assert Index.empty(spark).is_empty() and Index.empty(spark).search("x").count() == 0


def test_codec_of_batches(spark):
    import time

    r = random.Random(3)
    lists = [None, [], [0], [1 << 62, 127, 128], *[[r.randrange(1 << r.randint(1, 62)) for _ in range(r.randint(0, 9))] for _ in range(200)]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, x array<bigint>")
    got = {r.i: r for r in rows.select("i", codec.varint_encode(F.col("x")).alias("b"), codec.varint_decode(codec.varint_encode(F.col("x"))).alias("y"), codec.prefix_sum(F.transform("x", lambda v: v % 1000)).alias("s")).collect()}
    for i, x in enumerate(lists):
        assert got[i].y == x and got[i].s == (None if x is None else [sum(v % 1000 for v in x[: k + 1]) for k in range(len(x))])
        if x is not None:
            plain = b""
            for v in x:  # one number at a time
                while v > 127:
                    plain, v = plain + bytes([v & 127 | 128]), v >> 7
                plain += bytes([v])
            assert bytes(got[i].b) == plain
    began = time.time()
    assert codec._summed(__import__("pyarrow").array([[1] * 65_536]))[0].as_py() == list(range(1, 65_537)) and time.time() - began < 1


def test_codec_and_invariants(spark):
    ids = sorted(random.Random(1).sample(range(1 << 40), 200))
    row = spark.createDataFrame([(ids,)], "ids array<bigint>")
    coded = codec.varint_encode(codec.delta(F.col("ids")))
    got = row.select(codec.prefix_sum(codec.varint_decode(coded)).alias("back"), coded.alias("b"), F.aggregate(F.transform(codec.delta(F.col("ids")), codec.varint_size), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n")).first()
    assert got.back == ids and len(got.b) == got.n
    for bad in (b"\x80", b"\xff" * 11):
        with pytest.raises(codec.CodecError):
            codec.decode(bad)
    bad = spark.createDataFrame([("abc", "abcd", 0, [2, 1], 2), ("abc", "abcd", 0, [1], 2), ("abc", "abcd", 0, [], 0), ("abc", "abcd", 0, [1, 2], 2)], "p3 string, term string, block bigint, doc_ids array<bigint>, df bigint")
    assert index.violations(bad).count() == 3


def test_xor_filter_rates():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 10, 5000):
        keys = rng.integers(-(2**62), 2**62, n)
        f = filters.build(keys)
        assert filters.contains(f, keys).all()
        assert filters.contains(f, rng.integers(-(2**62), 2**62, 20000)).mean() < 0.01


def test_plan_uses_prefix_equi_join(spark):
    i = build(spark, [("Alpha", "beta")])
    q = spark.createDataFrame([(0, "alpha")], "query_id int, query string")
    plan = i.search_many(q, 5)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_stream(spark, tmp_path):
    from wordloom.streaming.search_stream import answer_stream

    i = build(spark, [("Alpha", "beta")])
    src = tmp_path / "q"
    spark.createDataFrame([(7, "alp")], "query_id int, query string").write.parquet(str(src))
    got = []
    s = spark.readStream.schema("query_id int, query string").parquet(str(src))
    run = answer_stream(i.docs, i.data, s, 3, lambda df, epoch: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert [(r.query_id, r.score) for r in got] == [(7, 2)]


def test_hits_of_many_queries_equal_hits_of_words(spark):
    """no row is made of a match of one word, over blocks, chunks, prefixes and repeated query ids."""
    from wordloom.operators import search

    r = random.Random(5)
    words = ["al", "alp", "alpha", "alphabet", "be", "bet", "beta", "gam", "gamma", "gammaray", "delta", "del"]
    some = lambda k: " ".join(r.choice(words) for _ in range(r.randint(0, k)))
    ids = [*range(40), *range(65_530, 65_545), 1 << 33, -1, -70_000]
    i = SearchEngine().with_stopwords(()).build(spark.createDataFrame([(d, some(3), f"/{d}", "", some(6)) for d in ids], POST))
    queries = spark.createDataFrame([*((k, some(6)) for k in range(300)), (3, "beta alpha"), (4, None)], "query_id int, query string")
    old = search.hits(i.docs, i.data, search.query_terms(queries))
    new = search.hits_many(i.docs, i.data, queries)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) and new.dtypes == old.dtypes
    assert sorted(map(tuple, i.search_many(queries, 3).collect())) == sorted(map(tuple, search.top(old, 3).collect()))
    plan = new._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(doc_ids" not in plan and search.hits_many(i.docs, i.data, queries.limit(0)).count() == 0


def test_posting_lists_of_many_pieces(spark, monkeypatch):
    """pieces of lists are made in each task and merged, whatever the order of their rows."""
    r = random.Random(7)
    pairs = {(r.choice([*range(-50, 50), *range(65_500, 65_600)]), r.choice("abcdefgh") * r.randint(1, 3)) for _ in range(3000)}
    rows = spark.createDataFrame([*pairs, (None, "a"), (None, "a")], "doc_id int, term string").repartition(7)
    want = {}
    for d, t in pairs:
        want.setdefault((t, d >> 16), []).append(d)
    got = index.build_postings(rows)
    assert dict(got.dtypes)["doc_ids"] == "array<int>"
    found = {(x.term, x.block): (x.doc_ids, x.df, x.p3) for x in got.collect()}
    assert found.pop(("a", None)) == ([], 2, "a")
    assert found == {(t, b): (sorted(d), len(d), t[:3]) for (t, b), d in want.items()} and got.count() == len(want) + 1
    import pyarrow as pa

    held = pa.RecordBatch.from_pylist([{"doc_id": d, "term": t} for d, t in sorted(pairs, key=lambda x: x[::-1])])
    monkeypatch.setattr(index, "GATHER_ROWS", 100)
    pieces = sorted((p for b in index._gathered(held.slice(k, 50) for k in range(0, len(held), 50)) for p in b.to_pylist()), key=lambda p: (p["term"], p["block"]))
    schema = pa.schema([("term", pa.string()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("df", pa.int64())])
    merged = [x for b in index._merged(pa.RecordBatch.from_pylist([p], schema) for p in pieces) for x in b.to_pylist()]
    assert {(x["term"], x["block"]): x["ids"] for x in merged} == {k: sorted(v) for k, v in want.items()} and len(merged) == len(want) < len(pieces)


def test_lower_case_first_equals_cleaning_first(spark):
    """all code points, alone and between letters, and texts with and without markup."""
    from wordloom.functions import text

    c = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    points = spark.range(0x110000).filter("id < 55296 or id > 57343").select(F.concat(F.lit("aB"), c, F.lit("Ca "), c, F.lit(" x."), c).alias("t"))
    late = F.filter(F.split(F.lower(text.clean(F.col("t"))), " "), lambda t: t != "")
    assert points.filter(~tokens(F.col("t")).eqNullSafe(late)).count() == 0
    rows = spark.createDataFrame([("ΟΔΟΣ.ΑΒ İx",), ("a<b>c</b>",), ("x &amp; y",), ("see [this](that)",), ("<!-- a -->b",), ("plain",), ("",), (None,)], "t string")
    got = [x[0] for x in rows.select(text.strip_markup(F.col("t"))).collect()]
    assert got == ["ΟΔΟΣ.ΑΒ İx", "a c ", "x   y", "see this", " b", "plain", "", None]
    assert rows.filter(~tokens(F.col("t")).eqNullSafe(F.filter(F.split(F.lower(text.clean(F.coalesce("t", F.lit("")))), " "), lambda t: t != ""))).count() == 0


def test_prep_schema_documents_on_odd_rows(spark, tmp_path):
    """repeated and null ids, nulls, texts that begin with a line break, other white space at the ends."""
    import duckdb

    from wordloom.plans import catalog

    texts = ["plain text", "\nafter a break", " \t lead and trail \n", "", "   ", "\xa0no-break\xa0", "　wide ", "\x0bvertical\x0c", "x" * 90 + "\n y", None, " " * 90 + "far", "a\r\n"]
    rows = [(i, t, "en", "src", 0) for i, t in enumerate(texts)] + [(0, "again", "de", "src", 0), (None, "no id", "en", "src", 0), (50, "no lang", None, "src", 0), (51, "no source", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["prep_schema_documents"](spark, str(tmp_path)).collect()]
    with duckdb.connect() as c:
        c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(catalog.ORACLES["prep_schema_documents"]).fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) == len(rows)


def test_filters_of_a_batch_equal_filters_alone():
    """filters are built and asked a batch at a time, with the same bytes and answers."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    lists = [rng.integers(-(2**63), 2**63 - 1, n) for n in [0, 1, 2, 3, 0, *rng.integers(0, 300, 300)]] + [np.array([5, 5, 7])]
    alone = [filters.build(x) for x in lists]
    kind = pa.list_(pa.int64())
    assert filters._build_all(pa.array(lists, kind)).to_pylist() == alone
    asked = [np.append(x, rng.integers(-(2**63), 2**63 - 1, 5)) for x in lists]
    assert filters._contains_all(pa.array(alone), pa.array(asked, kind)).to_pylist() == [filters.contains(f, x).astype(int).tolist() for f, x in zip(alone, asked)]
    assert filters._build_all(pa.array([], kind)).to_pylist() == filters._contains_all(pa.array([], pa.binary()), pa.array([], kind)).to_pylist() == []
