"""Operators against brute force, on small tables with nulls, empty and long texts, repeats and clashing names."""

import hashlib
import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import brute
from edgeloom.llm import bpe, components, embed_dedup, langid, mixing, mpeg_audio, simhash, substring_dedup, token_counts, token_store, url_filter
from edgeloom.llm._common import new_path
from edgeloom.llm.queries import ORACLE_SQL, QUERIES, RULES

SF = "/root/testdata/sf0.001"
random.seed(5)
VOCABULARY = ["the", "Of", "rain", "falls", "über", "naïve", "x1", "e=mc²", "日本語", "don't", "-", "plain", "river", "stone"]
SAYS = [" ".join(random.choices(VOCABULARY, k=k)) + random.choice([".", "!", "\n", "  "]) for k in (1, 2, 3, 5, 8, 13, 30)]


def prose(n):
    return "".join(random.choices(SAYS, k=n))


TEXTS = [None, "", " \n\t ", "one", "a b", "\x00", "😀 é\u0301", "wörter " * 5000, "nospace" * 4000, *(prose(k) for k in (1, 3, 5, 9, 20, 40))]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in all columns, a repeated row, equal texts, a hot source, and columns that operators use as well."""
    rows = [(i, t, f"s{i % 3}" if i % 4 else "hot") for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "hot"), (100, TEXTS[-1], None), (101, TEXTS[-1], "hot"), (None, "a b", "s1"), (102, "the", "")]
    rows = [(*r, "de" if i % 2 else None, 7, 1.5, "x") for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long, score double, removed string").repartition(3).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def empty(df):
    return df.where("false")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    near = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
    got = QUERIES[name](spark, sf).select(*columns).collect()
    assert Counter(map(near, got)) == Counter(map(near, want.fetchall()))


# 1


def test_mixing_reaches_its_targets(spark, docs, real):
    for df in (docs, real):
        plan = mixing.mix(df, plan_only=True).collect()
        assert len(plan) == df.count()
        sizes = {}
        for r in df.collect():
            n = len([w for w in (r["text"] or "").encode().replace(b"\x00", b"\x00").split()])
            sizes[r["source"]] = sizes.get(r["source"], 0) + n
        order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
        total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
        while open_:  # deal, stop at the caps, deal the excess again
            level = (total - sum(target.values())) / sum(weight[s] for s in open_)
            over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
            if not over:
                target |= {s: level * weight[s] for s in open_}
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            open_ -= over
        by_size = Counter((r["source_size"], round(r["target"], 6)) for r in plan)
        assert set(by_size) == {(sizes[s], round(target[s], 6)) for s in sizes}
        assert all(r["taken"] <= 2 * r["size"] and r["copies"] in (0, 1, 2) for r in plan)
    again = mixing.mix(real, plan_only=True).collect()
    assert sorted(map(repr, plan)) == sorted(map(repr, again))


def test_mixing_emits_what_it_plans(docs):
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns
    plan = mixing.mix(docs, plan_only=True)
    assert copies.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(empty(docs)).count() == mixing.mix(empty(docs), plan_only=True).count() == 0


# components


def test_components(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)] + [(2000, 2000 + i) for i in range(50)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["component"] for r in components.connected_components(df).collect()}
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(len(edges)):
        changed = False
        for a, b in edges:
            if a is not None and a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
        if not changed:
            break
    assert found == label
    assert components.connected_components(df.where("false")).count() == 0


# 2


def brute_vectors(rows, cosine=0.95):
    ok = {k: np.array(v, float) for k, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    link = {k: [] for k in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / (np.linalg.norm(ok[a]) * np.linalg.norm(ok[b])) >= cosine:
                link[a].append(b), link[b].append(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            todo = [n for t in todo for n in link[t] if n not in seen and not seen.add(n)]
        out.append((i, len(link[k]), min((rows[n][0] for n in seen if rows[n][0] is not None), default=None)))
    return out


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    rows = [(i, (base[i % 12] + rng.standard_normal(16) * 0.08).tolist()) for i in range(150)]
    rows += [(200 + i, base[0].tolist()) for i in range(30)] + [(300 + i, (base[1] + rng.standard_normal(16) * 0.01).tolist()) for i in range(60)]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None]), (404, [float("nan")] * 16), (405, [1.0] * 8), (406, [2.0] * 8), (407, [1e300] * 8), (408, (-base[0]).tolist()), (None, base[0].tolist()), (200, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<double>, label int, n_links int").repartition(3)
    monkeypatch.setattr(embed_dedup, "PART", 16)  # so that buckets are cut
    got = embed_dedup.embedding_groups(df).collect()
    # overflowing norms are the brute force's trouble only
    want = [r for r in brute_vectors([(i, [x / 1e290 for x in v] if v and v[0] == 1e300 else v) for i, v in rows])]
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in got) == sorted((i is None, i or 0, n, c if c is not None else i) for i, n, c in want)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embed_dedup.embedding_groups(empty(df)).count() == 0


def test_embeddings_whose_ids_repeat_or_are_missing(spark):
    rng = np.random.default_rng(4)
    a, b, c, d = (rng.standard_normal(16) for _ in range(4))
    near = lambda x: (x + rng.standard_normal(16) * 0.02).tolist()
    rows = [(5, near(a)), (5, near(b)), (2, near(a)), (7, near(b)), (None, near(c)), (11, near(c)), (None, near(d)), (None, near(d)), (-3, None), (None, None), (2, a.tolist()), (2, a.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = embed_dedup.embedding_groups(df).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == sorted((str(i), n, str(k)) for i, n, k in brute_vectors(rows))
    assert Counter((r["vec_id"], r["component_id"]) for r in got if r["kept"]) == Counter({(2, 2): 3, (5, 5): 1, (11, 11): 1, (-3, -3): 1})


def test_pairs_near_the_threshold_are_met(spark):
    rng = np.random.default_rng(8)
    n = 1500
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a, b = unit(rng.standard_normal((n, 64))), rng.standard_normal((n, 64))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.9501, 0.96, (n, 1))
    rows = [(i, v) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]).tolist())]
    got = embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got.agg(F.sum("n_links")).first()[0] >= 0.99 * 2 * n


# 3, 8, 9


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path("byte_bpe_50k.tiktoken")), special_tokens={})


class Library:
    """The tokenizers library itself."""

    def __init__(self, name):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(bpe.default_path(name))

    def encode_ordinary(self, text):
        return self.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"])
def test_encoding_is_that_of_the_library(name, encoding):
    import tiktoken

    if "multi" in name:
        encoding = tiktoken.Encoding("multi", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.read_ranks(bpe.default_path(name)), special_tokens={})
    if "json" in name:
        encoding = Library(name)
        assert encoding.encode_ordinary("a<|endoftext|>b") == [64, 50256, 65]
    v = bpe.Vocabulary(bpe.default_path(name), bpe.default_pattern())
    alphabet = [chr(i) for i in range(1, 0x250)] + list("  \n\t'''smdtrevl ²ⅷ日本\u3000\u2028\u0301😀\u0558\x1c\x85\xa0")
    texts = ["".join(random.choices(alphabet, k=random.randrange(60))) for _ in range(3000)] + [t for t in TEXTS if t] + ["", "it's we'll I'd 'sure  '  x", "a\n\n b \n", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>x", "<|endoftext|", "wörter " * 90_000 + "<|endoftext|> 's"]
    random.shuffle(texts)
    for t, ids in zip(texts, v.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t), repr(t)
        assert v.decode(ids) == t.encode()


def test_pieces_of_one_hash_are_told_apart(encoding, monkeypatch):
    """Every piece has the same hash, so only the comparison of bytes tells them apart."""
    monkeypatch.setattr(bpe, "ODD", np.zeros_like(bpe.ODD))
    v = bpe.Vocabulary(bpe.default_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    texts = [prose(9) for _ in range(30)]
    for _ in range(2):
        for t, ids in zip(texts, v.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == encoding.encode_ordinary(t)


def test_every_character_is_cut_as_the_library_cuts_it(encoding):
    v = bpe.Vocabulary(bpe.default_path("byte_bpe_50k.tiktoken"), bpe.default_pattern())
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{c}a{c}1{c}!{c} {c}" for c in chars[i : i + 400]) for i in range(0, len(chars), 4000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode_all(texts)] == [encoding.encode_ordinary(t) for t in texts]


def test_encode_and_decode(docs, encoding):
    encoded = bpe.encode(docs)
    for r in encoded.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        t = r["text"] or ""
        assert r["ids"] == encoding.encode_ordinary(t)
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"])
        assert not t or (r["begins"][0] == 0 and r["ends"][-1] == len(t))
        for i, b, e in list(zip(r["ids"], r["begins"], r["ends"], strict=True))[:50]:
            assert encoding.decode_single_token_bytes(i) in t[b:e].encode()
    whole = bpe.decode(encoded).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert whole and all(bytes(r["content"]) == (r["text"] or "").encode() for r in whole)
    want = sorted((str(i), len(ids := encoding.encode_ordinary(t or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.digests(docs).collect()) == want
    assert bpe.encode(empty(docs)).count() == bpe.digests(empty(docs)).count() == 0


def test_token_store_keeps_ids_in_order(spark, docs):
    encoding = Library("byte_bpe_50k.json")
    marked = [(i, t, None, None, 1, 0.0, None) for i, t in ((None, None), (None, "x"), (200, "one<|endoftext|>two"), (201, "<|endoftext|>"))]
    docs = docs.where("doc_id is not null").unionByName(spark.createDataFrame(marked, docs.schema))
    target = new_path(spark, "store")
    token_store.write_store(docs, target)
    got = sorted(token_store.read_store(spark, target).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in docs.collect()), key=lambda i: (i is not None, i))
    start, want = 0, []
    for r in docs.collect():
        ids = np.array([*encoding.encode_ordinary(r["text"] or ""), 0], "<u4")
        want.append((str(r["doc_id"]), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    none = new_path(spark, "store")
    token_store.write_store(empty(docs), none)
    assert token_store.read_store(spark, none).count() == 0


@pytest.mark.parametrize("first_rule", [50_257, 200_000])
def test_grammar_is_lossless_and_random_access(first_rule):
    rng = np.random.default_rng(1)
    for ids in (rng.zipf(1.3, 30_000) % 500, np.zeros(5000, int), np.zeros(0, int), np.array([7]), np.tile([1, 2, 3], 2000), np.tile(rng.integers(0, 900, 300), 100), np.full(5000, first_rule - 1)):
        body, rules, levels = token_store.compress(ids.astype(np.uint32), first_rule)
        assert (token_store.expand(body, rules, levels, first_rule) == ids).all()
        assert np.array_equal(token_store.expand_all(body, rules, levels, first_rule, token_store.expansion_lengths(rules, levels, first_rule)), ids)
        left = Counter()  # of pairs that don't overlap, none is left as often as gets a rule
        at = {}
        for k, pair in enumerate(zip(body.tolist(), body[1:].tolist(), strict=False)):
            if at.get(pair, -2) < k - 1:
                left[pair] += 1
                at[pair] = k
        assert not left or max(left.values()) < token_store.LEAST
        for rule, n in zip(rules.tolist(), token_store.expansion_lengths(rules, levels, first_rule).tolist(), strict=True):
            assert len(token_store.expand(np.array(rule), rules, levels, first_rule)) == n
        sizes = [len(ids) // 3, 0, len(ids) - len(ids) // 3]
        cuts = np.cumsum([0, *sizes])
        row = token_store._shard_row(0, 0, [1, 2, 3], [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], first_rule).to_pylist()[0]
        for _ in range(20):
            lo = random.randint(0, len(ids))
            hi = random.randint(lo, len(ids))
            assert (token_store.read_ids(row, lo, hi) == ids[lo:hi]).all()
        assert all((token_store.read_document(row, k) == ids[cuts[k] : cuts[k + 1]]).all() for k in range(3))
    assert len(body) < 5000 / 100


def test_length_histogram(spark, docs, real):
    encoding = Library("byte_bpe_50k.json")
    marked = spark.createDataFrame([(1, "a<|endoftext|>b<|endoftext|>")], "doc_id long, text string")
    for df in (docs, real, marked):
        lengths = [len(encoding.encode_ordinary(r["text"] or "")) for r in df.select("text").collect()]
        limits = token_counts.context_limits(token_counts.histogram(df)).cache()
        for r in limits.collect():
            n = r["n_tokens"]
            assert (r["n_docs"], r["docs_at_least"], r["tokens_at_least"]) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
            assert r["truncated_total"] == sum(min(x, n) for x in lengths)
            assert abs(r["share_at_most"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
        assert limits.count() == len(set(lengths))
        assert token_counts.truncated_total(limits, 11).first()[0] == sum(min(x, 11) for x in lengths)
        assert token_counts.quantile(limits, 0.5).first()[0] == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.context_limits(token_counts.histogram(empty(docs))).count() == 0


# 4


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = simhash.simhash_groups(docs).withColumn("hex", simhash.hex_of("fp")).collect()
    fps = {t: brute_fingerprint(t) for _, t in rows}
    assert sorted((str(r["doc_id"]), r["hex"]) for r in got) == sorted((str(i), f"{fps[t]:016x}") for i, t in rows)
    assert len({r["component_id"] for r in got if int(r["hex"], 16) == 0}) == 1
    assert simhash.simhash_groups(empty(docs)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 3").count() == 1
    odd = [(1, "foo"), (5, "foo"), (5, "bar"), (5, "bar"), (2, "bar baz"), (None, "foo"), (7, None), (8, ""), (1, "qux")]
    left = simhash.keep_one(spark.createDataFrame(odd, "doc_id long, text string"))
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(1, "foo"), (5, "bar"), (2, "bar baz"), (None, "foo"), (7, None), (1, "qux")]))


@pytest.mark.parametrize("most", [2, 8, 128])
def test_near_fingerprints_are_joined_in_cold_and_hot_buckets(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_PAIRED", most)
    random.seed(most)
    fps = {random.getrandbits(64) for _ in range(40)}
    for x in list(fps)[:20]:
        for _ in range(25):
            fps.add(x := x ^ sum(1 << b for b in random.sample(range(64), random.choice([1, 2, 3]))))
    signed = [simhash._signed(x) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["component"] for r in components.connected_components(simhash.near_links(df)).collect()}
    a = np.array(signed)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 2
    label = a.copy()
    while not np.array_equal(label, new := np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1)):
        label = new
    assert all(found.get(x, x) == lab for x, lab in zip(signed, label.tolist(), strict=True))


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


# 5


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "http://example.com/en/8", "http://com/en/", "http://telecom/en/1", "https://x.net/de/1", "https://example.net/de/8/9", "ftp://q.org/es/", "http://h?q=/en/", "http://h#f", "a://b://c/d", "http://www.example.com//en/7", "http://x.com/a/b/c/d/e/f"] + [f"http://big.example.com/{'en' if i % 3 else 'fr'}/{i}" for i in range(60)]
    df = spark.createDataFrame([(i % 70, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, n string").repartition(3)
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(urls)

    def parse(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in RULES if (host == r[0].split("/")[0] or host.endswith("." + r[0].split("/")[0])) and path.startswith("/" + r[0].split("/", 1)[1])]
        best = max(fits, key=lambda r: len(r[0]), default=(None, None))
        return host, path, best[0], best[1]

    assert Counter((r["host"], r["path"], r["rule"]) for r in got) == Counter(parse(u)[:3] for u in urls)
    assert all(r["verdict"] == dict(RULES)[r["rule"]] for r in got if r["rule"])
    assert {r["verdict"] for r in got} == {"allow", "block"}
    assert {r["template"] for r in got if r["host"] == "big.example.com"} == {"big.example.com/en/*", "big.example.com/fr/*"}
    assert url_filter.judge(empty(df), RULES).count() == 0
    deep = spark.createDataFrame([(i, f"http://deep.com/a/b/c/d/e/{i}/{'x' if i % 2 else 'y'}") for i in range(60)], "page_id long, url string")
    assert {r["template"] for r in url_filter.judge(deep, RULES).collect()} == {"deep.com/a/b/c/d/e/*/x", "deep.com/a/b/c/d/e/*/y"}
    assert {r["template"] for r in url_filter.judge(deep, RULES, depth=6).collect()} == {"deep.com/a/b/c/d/e/*"}
    assert {r["template"] for r in url_filter.judge(deep, RULES, depth=0).collect()} == {"deep.com"}
    tied = url_filter.judge(df.limit(1).selectExpr("page_id", "'http://x.com/e/a' AS url"), [("x.com/e", "block"), ("com/e/a", "allow")]).first()
    assert (tied["rule"], tied["verdict"]) == ("com/e/a", "allow")


# 6


def test_language_id(spark, real, docs):
    filters = langid.learn(real.where(~langid.held_out()))
    rows = langid.predict(real.withColumn("held", langid.held_out()), filters, ["doc_id", "lang", "held"]).collect()
    apart = [r for r in rows if r["held"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in apart) >= 0.95 * len(apart) > 0
    odd = langid.predict(docs, filters, ["doc_id", "score"], names=("lang_pred", "sure")).collect()
    assert len(odd) == docs.count() and all(0 <= r["sure"] <= 1 for r in odd)
    by_id = {r["doc_id"]: r["lang_pred"] for r in odd}
    assert by_id[0] == by_id[1] == by_id[2] == by_id[5] == "und" and by_id[3] in filters.languages
    none = langid.learn(empty(real))
    assert {r["lang_pred"] for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty(docs), filters, ["doc_id"]).count() == 0
    assert langid.learn(docs.where("text is not null")).languages == ["de"]


def test_predictions_are_those_of_plain_sets(real):
    """The n-grams of labelled documents in sets: no filter, no hash."""
    def grams(t):
        plain = "".join(c if c.isalpha() else " " for c in t.lower())
        words = plain.split()
        return [f" {w} "[i : i + n] for w in words for n in langid.GRAMS for i in range(len(w) + 3 - n)]

    rows = real.withColumn("held", langid.held_out()).collect()
    learned = [r for r in rows if not r["held"] and r["lang"] is not None and r["text"] is not None]
    counts, texts = {}, Counter(r["lang"] for r in learned)
    for r in learned:
        counts.setdefault(r["lang"], Counter()).update(set(grams(r["text"])))
    rate = {lang: {g: n / texts[lang] for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    top = {}
    for of in rate.values():
        for g, x in of.items():
            top[g] = max(top.get(g, 0), x)
    known = {lang: {g for g, x in of.items() if x >= 0.004 and x >= 0.2 * top[g]} for lang, of in rate.items()}
    filters = langid.learn(real.where(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.predict(real, filters, ["doc_id"]).collect()}
    for r in rows:
        own = grams(r["text"] or "")
        shares = {lang: sum(g in of for g in own) / len(own) for lang, of in known.items()} if own else {}
        best = max(shares.values(), default=0)
        assert abs(got[r["doc_id"]]["score"] - best) < 0.02
        if got[r["doc_id"]]["lang_pred"] == "und":
            assert not own
        else:
            assert shares[got[r["doc_id"]]["lang_pred"]] > best - 0.02


def test_filters_are_those_of_many_languages():
    f = langid.Filters([f"l{i}" for i in range(130)])
    words = {i: "".join(random.choices("abcdefghijklmnop", k=9)) for i in range(130)}
    for i, w in words.items():
        f.add(i, np.concatenate(list(langid.gram_hashes(w))))
    f.fill()
    assert all(f.decide(w) == (f"l{i}", 1.0) for i, w in words.items())
    assert f.decide("12 3!") == ("und", 0.0)


def test_pieces_of_a_long_text_lose_no_gram(monkeypatch):
    text = prose(60)
    whole = np.sort(np.concatenate(list(langid.gram_hashes(text))))
    monkeypatch.setattr(langid, "CHUNK", 37)
    assert np.array_equal(whole, np.sort(np.concatenate(list(langid.gram_hashes(text)))))


# 7


def test_substring_dedup(docs, real):
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2])
    for df in (docs, real):
        cut = substring_dedup.remove_repeats(df)
        got = [(r["doc_id"], r["text"], [tuple(s) for s in r["removed"]]) for r in cut.collect()]
        assert sorted(got, key=key) == sorted(brute.cut([(r["doc_id"], r["text"]) for r in df.collect()]), key=key)
        assert set(cut.columns) == set(df.columns) | {"removed"}
    assert substring_dedup.remove_repeats(empty(docs)).count() == 0


def test_rows_without_an_id_lose_what_others_have(spark):
    passage, other = prose(9), prose(9)
    rows = [(5, passage), (None, passage), (None, passage), (None, f"{other} {passage}"), (None, other), (7, None), (7, f"x {other}"), (7, other)]
    got = [(r["doc_id"], r["text"], [tuple(s) for s in r["removed"]]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute.cut(rows)))


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_words_are_cut_and_told_apart(monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    texts = [t or "" for t in TEXTS] + ["x.y.z", "  lead", "ABC abc Abc aBd", "\u0130 i \u1e9e \u00df \U0001d49c \x1c-\x1d a"]
    texts += ["".join(random.choices(" \n\tab-C1\u00e9\u00c9\u65e5 .", k=random.randrange(40))) for _ in range(300)]
    found = substring_dedup.Words(texts)
    at, known = found.firsts[found.text], found.counted
    got = list(zip(found.text[known].tolist(), (found.begins - at)[known].tolist(), (found.ends - at)[known].tolist(), strict=True))
    want = [(k, w) for k, t in enumerate(texts) for w in brute.words_of(t)]
    assert got == [(k, b, e) for k, (b, e, _) in want]
    assert len(set(found.hashes.tolist())) == len({w for _, (*_, w) in want}) == len(set(zip(found.hashes.tolist(), (w for _, (*_, w) in want), strict=True)))


def test_a_passage_is_found_inside_other_lines(spark):
    words = lambda n, s: " ".join(f"{s}{random.randrange(10**6)}" for _ in range(n))
    plain = words(60, "p")
    said = " ".join(f"{words(7, 'q')}." for _ in range(9))
    rows = [(1, f"{words(30, 'a')} {plain} {words(30, 'b')}"), (2, f"{words(11, 'c')}. {said} {words(5, 'd')}"), (3, f"{words(40, 'e')} {plain} {words(3, 'f')}"), (4, f"{words(20, 'g')}\n{words(3, 'h')} {said} {words(30, 'i')}"), (5, words(200, "j"))]
    got = {r["doc_id"]: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(got[i]["removed"]) for i in (1, 2, 5)] == [0, 0, 0]
    assert sum(w in got[4]["text"] for w in said.split()) <= 15
    assert got[3]["removed"] and sum(w in got[3]["text"].split() for w in plain.split()) <= 40


# 10


def test_audio_keeps_the_payload(docs):
    read = mpeg_audio.feature(mpeg_audio.read_audio(mpeg_audio.to_audio(docs), ["doc_id", "n_bytes"])).collect()
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((str(r["doc_id"]), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in read) == sorted(want)
    assert all(r["bad_checksums"] == r["skipped"] == 0 and r["frames"] == len(r["seek_offsets"]) and r["samples"] == 1152 * r["frames"] and r["table_kind"] == "Xing" and r["table_agrees"] for r in read)
    assert all(Fraction(r["seconds"]) == Fraction(r["samples"], 48000) for r in read)
    assert len({(r["payload_sha256"], r["feature"], r["media_sha256"]) for r in read}) == len({r["payload_sha256"] for r in read})
    assert mpeg_audio.to_audio(empty(docs)).count() == 0


def test_audio_keeps_a_payload_that_looks_like_a_tag():
    for size in (64, 128, 960, 1024):
        for at in range(max(0, size - 200), size - 2):
            payload = bytearray(b"y" * size)
            payload[at : at + 3] = b"TAG"
            read = mpeg_audio.read_stream(mpeg_audio.write_stream(bytes(payload)))
            assert read.payload == payload and not read.skipped and read.table_agrees
    assert mpeg_audio.read_stream(mpeg_audio.write_stream(mpeg_audio.payload_of(b"x" * 17 + b"TAG" + b"y" * 60))).payload.rstrip(b"\0") == b"x" * 17 + b"TAG" + b"y" * 60


@pytest.mark.parametrize(("layer", "head", "bits"), [(1, (0x84, 0xC0), 128), (1, (0x84, 0x00), 256), (1, (0x84, 0x50), 160), (2, (0x84, 0xC0), 88), (2, (0xC4, 0x00), 176), (2, (0x14, 0xC0), 26)])
def test_checksums_of_layers_one_and_two(layer, head, bits):
    """A protected frame: its allocations (all 1, so that two more bits each follow in layer II), then anything."""
    header = bytes([0xFF, 0xF8 | (4 - layer) << 1, *head])
    frame = mpeg_audio.frame_header(header)
    assert (frame.layer, frame.protected) == (layer, True)
    rng = np.random.default_rng(layer)
    body = bytearray(rng.integers(0, 256, frame.size - 6, dtype=np.uint8).tobytes())
    if layer == 2:
        body[:22] = b"\xff" * 22
    covered = mpeg_audio.covered_bits(frame, header + b"\0\0" + bytes(body), 0)
    widths = {88: 27, 176: 54, 26: 8}
    assert covered == (bits if layer == 1 else bits + 2 * widths[bits])
    stream = [int(b) for byte in header[2:] + bytes(body) for b in f"{byte:08b}"][: 16 + covered]
    crc = [1] * 16  # a shift register, bit by bit
    for b in stream:
        out = crc[0] ^ b
        crc = [*crc[1:], 0]
        if out:
            crc = [x ^ y for x, y in zip(crc, [1, *[0] * 12, 1, 0, 1], strict=True)]
    crc = int("".join(map(str, crc)), 2).to_bytes(2, "big")
    data = header + crc + bytes(body)
    assert mpeg_audio.read_stream(data * 3).bad_checksums == 0
    for bit, bad in ((0, 3), (covered - 1, 3), (covered, 0)):
        hurt = bytearray(data)
        hurt[6 + bit // 8] ^= 0x80 >> bit % 8
        if layer == 1 or bit >= bits:
            assert mpeg_audio.read_stream(bytes(hurt) * 3).bad_checksums == bad


def test_audio_reader():
    payload = bytes(range(256)) * 20
    data = mpeg_audio.write_stream(payload)
    good = mpeg_audio.read_stream(data)
    assert good.payload == payload and good.table["frames"] == len(good.offsets) and len(good.table["seek"]) == 100
    hurt = bytearray(data)
    hurt[good.offsets[2] + 8] ^= 1
    assert mpeg_audio.read_stream(bytes(hurt)).bad_checksums == 1
    tag = mpeg_audio._tag(data, mpeg_audio.Stream())
    torn = b"noise\xff\xfb" + data[tag : good.offsets[2]] + b"\xff\xff\0" + data[good.offsets[2] :] + b"TAG".ljust(128, b"\0")
    again = mpeg_audio.read_stream(torn)
    assert len(again.offsets) == len(good.offsets) and again.skipped == 10 and again.samples == good.samples
    for junk in (b"", b"ID3", b"ID3\x03\0\0\x7f\x7f\x7f\x7f", b"\xff" * 100, data[:3], data[: tag + 50]):
        assert mpeg_audio.read_stream(junk).offsets == []
    # a known header: MPEG-1 layer III, 128 kbit/s, 44.1 kHz, padded, stereo
    frame = mpeg_audio.frame_header(bytes([0xFF, 0xFB, 0x92, 0x00]))
    assert (frame.size, frame.samples, frame.rate, frame.kbps, frame.side) == (418, 1152, 44100, 128, 32)
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # CRC-16/CMS
