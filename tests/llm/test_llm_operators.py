"""The operators of quillgraph.llm on small fixtures, against plain versions and libraries."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing, quality, shingle_join
from quillgraph.llm.chat import canonical, format_chats, invalid
from quillgraph.llm.exact_dedup import exact_dedup
from quillgraph.llm.pii import pseudonymize, surrogates
from quillgraph.llm.queries_tokens import digests, model_path
from quillgraph.llm.sentencepiece_bpe import Model, encode_decode
from quillgraph.llm.shingle_join import jaccard_components
from quillgraph.llm.topk import topk
from quillgraph.llm.url_filter import rules_frame, url_filter

SF = "/root/testdata/sf0.001"
LONG = "Lorem ipsum dolor sit amet consectetur " * 4000
#: Null, empty, white space, repeated rows, a very long text, other white space, an emoji.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "a  b"), (4, "a  b"), (5, "a\tb"), (6, LONG), (7, "x" * 30_000), (8, "😀 ▁é\x00")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id long, text string")
    # columns whose names the operators use themselves
    return frame.withColumns({"id": F.lit("c"), "n": F.lit(1), "key": F.lit(2), "t": F.lit(3), "kept": F.lit(4), "score": F.lit(5)})


def empty(docs):
    return docs.where("false")


# --- SentencePiece


def test_sentencepiece_equals_the_library(spark, docs, odd):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = digests(encode_decode(both, model_path())).collect()
    want = []
    for r in both.collect():
        ids = [*lib.encode(r.text or ""), 2]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    assert sorted(map(tuple, got)) == sorted(want)
    assert encode_decode(empty(docs), model_path()).count() == 0


def test_sentencepiece_random_texts():
    import sentencepiece

    lib, m, rng = sentencepiece.SentencePieceProcessor(model_file=model_path()), Model(model_path()), random.Random(3)
    parts = ["a", "th", " ", "   ", "▁", "é", "ß", "\n", "漢", "😀", "<s>", "<0x0A>", "the", " and", "aaaa", "'s", "99"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = m.encode([t])[0]
        assert ids.tolist() == [*lib.encode(t), 2] and m.decode(ids) == lib.decode(ids.tolist())
    for t in ("a" * 9000, " " * 3000, "ab" * 4000, "漢" * 3000):
        assert m.encode([t])[0].tolist() == [*lib.encode(t), 2]


# --- language and quality


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    fitted = langid.fit(docs.where(fold != 0))
    held = langid.identify(docs.where(fold == 0), fitted).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = held.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97


def test_language_edge_cases(spark, docs, odd):
    fitted = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(odd, fitted).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0 and got[6].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(empty(docs))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}


def test_quality_of_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    fitted = quality.fit(docs, labels.where(fold != 1))
    held = quality.score(docs, fitted).join(labels.where(fold == 1), "doc_id")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 80 and right > 0.95
    scored = quality.score(odd, fitted).collect()
    assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(odd, quality.fit(docs, labels.where("false"))).agg(F.max("score")).first()[0] == 0.5


# --- duplicates


def test_exact_dedup_edge_cases(spark, odd, docs):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(odd).collect()}
    assert (1, 1, 2, True) in got and (2, 1, 2, False) in got and (3, 3, 1, True) in got
    assert (4, 4, 3, True) in got and (5, 4, 3, False) in got
    assert exact_dedup(odd).count() == len(ODD) and exact_dedup(empty(docs)).count() == 0


def brute_components(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((root(a), root(b)))
                part[q] = p
    return {(i, len(sets[i]), root(i)) for i in sets}


def test_components_equal_brute_force(spark, docs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    rows, passage = [], " ".join(word() for _ in range(30))
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 6, 20, 60, 90]))]
        for _ in range(rng.randint(1, 7)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = word()
            cut = rng.randint(0, 8)
            rows.append(" ".join(w[cut:] if len(w) > 30 else w).upper() + (f" {passage}" if g % 4 == 0 else ""))
    pairs = list(enumerate(rows)) + [(1000, None), (1001, ""), (1002, rows[0]), (1003, "one two"), (1004, "One  TWO")]
    real = [(r.doc_id + 5000, r.text) for r in docs.select("doc_id", "text").collect()]
    frame = spark.createDataFrame(pairs + real, "doc_id long, text string").withColumns({"id": F.lit(0), "token": F.lit(0)})
    got = {tuple(r) for r in jaccard_components(frame).collect()}
    assert got == brute_components(pairs + real)
    assert len({r[2] for r in got}) < len(got)


@pytest.mark.parametrize("load", [40, 1 << 19])
def test_opened_groups_equal_brute_force_in_any_blocks(spark, monkeypatch, load):
    monkeypatch.setattr(shingle_join, "LOAD", load)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(2)]
    texts = {}
    for i in range(48):
        w = list(base[i % 2])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(900)}"
        texts[i] = " ".join(w)
    sets = {i: set(shingle_join.token_set(t).tolist()) for i, t in texts.items()}
    held, asking = [i for i in texts if i < 32], [i for i in texts if i >= 32]
    docs = spark.createDataFrame(list(texts.items()), "id long, text string")
    members = spark.createDataFrame([(i % 2, i, len(sets[i])) for i in held], "g long, id long, n long")
    opened = spark.createDataFrame([(a, len(sets[a]), g) for a in asking for g in (0, 1)], "a long, na long, g long")
    got = {tuple(r) for r in shingle_join.open_groups(docs, opened, members).collect()}
    links = {(a, b) for a in asking for b in held if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert got <= links and {(a, b % 2) for a, b in got} == {(a, b % 2) for a, b in links}
    assert 0 < len({a for a, _ in links}) < len(asking)


def test_groups_open_where_an_inner_size_needs_fewer_tokens(spark):
    # Q and X link (9 of 12 shingles); a partner of X's size needs 1 shared prefix token, those of
    # its group's least and largest sizes, Z's and Y's, need 2.  Y and Z are the shared token's pivots
    # (first id, last id, first by hash), and Q links with neither
    core = [f"c{i}" for i in range(1, 14)]
    rows = [(5, [*core, "q"]), (6, [*core, "x", "y"]), (1, [*core, "x", "y", "z"]), (9, [*core[1:], "x", "y"]), (20, [w for w in core[7::-1] for _ in range(3)])]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = brute_components(rows)
    assert {i for i, _, c in want if c == 1} == {1, 5, 6, 9}
    assert {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_fewest_tokens_of_a_range_of_sizes(spark):
    least = lambda n, m: max(1, -(-3 * (n + m) // 7) - (-(-3 * max(n, m) // 4) - 1))
    cases = [(n, lo, hi) for n in (*range(1, 45), 100, 1000) for lo in range(-(-3 * n // 4), 4 * n // 3 + 1, max(1, n // 40)) for hi in (*range(lo, min(4 * n // 3, lo + 12) + 1), 4 * n // 3)]
    frame = spark.createDataFrame(cases, "n long, lo long, hi long")
    got = frame.select("n", "lo", "hi", shingle_join.fewest(F.col("n"), F.col("lo"), F.col("hi"))).collect()
    assert [tuple(r) for r in got] == [(n, lo, hi, min(least(n, m) for m in range(lo, hi + 1))) for n, lo, hi in cases]


def test_one_id_on_different_texts(spark):
    word = lambda i: " ".join(f"w{i}{k}" for k in range(40))
    rows = [(1, word(1)), (1, word(2)), (2, word(2) + " more"), (3, word(1) + " again"), (4, word(4)), (4, word(4)), (5, ""), (1, "")]
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 36, 1), (2, 37, 1), (3, 37, 1), (4, 36, 4), (5, 0, 5), (1, 0, 1)}


def test_groups_of_near_copies_with_shifted_starts_equal_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for g in range(60):
        # links of exactly 3/4 are frequent: small sets that share all but a few words at either end
        n = rng.randint(13, 30)
        base = [f"g{g}w{i}" for i in range(n)]
        for _ in range(rng.randint(3, 6)):
            w = base[rng.randint(0, 3) : n - rng.randint(0, 3)]
            w = [f"g{g}h{rng.randint(0, 3)}" for _ in range(rng.randint(0, 2))] + w + [f"g{g}t{rng.randint(0, 3)}" for _ in range(rng.randint(0, 2))]
            rows.append(" ".join(w))
        rows.append(" ".join(x for x in base[::-1] for _ in range(rng.choice([1, 3]))))
    pairs = list(enumerate(rows))
    rng.shuffle(pairs)
    got = {tuple(r) for r in jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert got == brute_components(pairs)


def test_components_edge_cases(spark, odd, docs):
    got = jaccard_components(odd).collect()
    assert len(got) == len(ODD) and {(r.doc_id, r.n_shingles, r.component_id) for r in got} >= {(1, 0, 1), (3, 0, 3), (5, 1, 4)}
    assert jaccard_components(empty(docs)).count() == 0


# --- top-k


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    base = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    odd = [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (102, [float("inf")] * 6), (103, base[0][1]), (104, base[0][1]), (105, [3e5] * 6), (106, [])]
    frame = spark.createDataFrame(base + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = sorted(tuple(r) for r in topk(frame, F.col("vec_id") % 10 == 0, 4).collect())
    ok = {i: [int(np.floor(1024 * x)) for x in v] for i, v in base + odd if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 10 == 0):
        s = sorted((-sum(a * b for a, b in zip(ok[q], ok[v], strict=False)), v) for v in ok if v != q)[:4]
        want += [(q, r + 1, v, -n) for r, (n, v) in enumerate(s)]
    assert got == sorted(want)
    assert topk(frame.where("false"), F.lit(True)).count() == 0


# --- mixing


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    weights = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    labels = docs.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labels, weights).select("mix_tokens", "mix_posterior", "mix_rate", "mix_copies").toPandas()
    p, w, x = np.stack(got.mix_posterior), got.mix_tokens.to_numpy(float), got.mix_rate.to_numpy()
    total = (p * (w * x)[:, None]).sum(axis=0)
    assert np.allclose(total / total.sum(), [0.2, 0.4, 0.2, 0.2], atol=2e-3)  # de, en, es, fr
    assert (x >= 0).all() and abs(got.mix_copies.mean() - x.mean()) < 0.05
    # the same descent in numpy
    size = (p * w[:, None]).sum(axis=0)
    share = np.array([0.2, 0.4, 0.2, 0.2])
    target, y = mixing.SLACK * (size / share).max() * share, np.ones(len(w))
    for _ in range(mixing.STEPS):
        y = np.maximum(0, y - p @ (((p * (w * y)[:, None]).sum(axis=0) - target) / size))
    assert np.abs(x - y)[w > 0].max() < 1e-2


def test_mixing_learns_scarce_domains(spark):
    # 5 of 3005 labelled documents, and a bound of 20: a uniform draw holds none of them
    docs = spark.range(3005).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "sun moon star").otherwise("rare words here").alias("text"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 3000, "sky").otherwise("rare").alias("domain"))
    fitted = mixing.fit_domains(docs, labels, limit=20)
    assert fitted.names == ["rare", "sky"]
    got = fitted.add_posteriors(docs, "text").groupBy("text").agg(F.first("p").alias("p")).collect()
    assert all(r.p[0] > 0.99 if r.text.startswith("rare") else r.p[1] > 0.99 for r in got)
    with pytest.raises(ValueError, match="sea"):
        mixing.mix(docs, labels, {"sky": 0.5, "sea": 0.5})


def test_mixing_edge_cases(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, domain string")
    got = mixing.mix(odd, labels).collect()
    assert len(got) == len(ODD) and {r.mix_rate for r in got} == {1.0} and {r.mix_copies for r in got} == {1}
    known = spark.createDataFrame([(4, "x"), (6, "y"), (8, None)], "doc_id long, domain string")
    got = mixing.mix(odd, known).collect()
    assert len(got) == len(ODD) and all(r.mix_rate >= 0 for r in got)


# --- chats


TOOLS = {"search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}}, "additionalProperties": False}}


def test_chat_links_orders_and_validates(spark):
    call = lambda i, args, name="search": f'<tool_call>{canonical({"id": i, "name": name, "arguments": args})}</tool_call>'
    result = lambda i: f'<tool_result>{canonical({"id": i, "content": 1})}</tool_result>'
    ref = {"query": {"$ref": "a"}}
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call("b", ref) + call("a", {"query": "x"})), (1, 2, "tool", result("a")), (1, 3, "tool", result("b") + result("z")), (1, 4, "assistant", call("c", {"q": 1}) + call("d", {"query": {"$ref": "e"}}) + call("e", {"query": {"$ref": "d"}}) + call("a", {"query": "y"}) + call("f", {}, "nope") + "<tool_call>{</tool_call>"), (2, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))
    got = format_chats(frame, TOOLS).orderBy("conv_id", "pos").collect()
    at = {(r.kind, r.call_id, r.turn): r for r in got}
    order = [at["call", "a", 1].pos, at["result", "a", 2].pos, at["call", "b", 1].pos, at["result", "b", 3].pos]
    assert order == sorted(order)
    assert at["result", "z", 3].status == "orphan" and at["call", "c", 4].status == "arguments: query is missing"
    assert at["call", "d", 4].status == at["call", "e", 4].status == "cycle"
    assert at["call", "a", 4].status == "duplicate" and at["call", "f", 4].status == "unknown tool"
    assert [r.pos for r in got if r.conv_id == 1] == list(range(1, 13)) and got[-1].json == '{"content":"","role":null}'
    assert format_chats(frame.where("false"), TOOLS).count() == 0


def test_schema_breaches():
    schema = {"type": "object", "properties": {"n": {"type": "integer"}, "m": {"enum": [1, 2]}, "l": {"type": "array", "items": {"type": "string"}}}}
    assert invalid({"n": 1, "m": 2, "l": ["a"]}, schema) is None
    assert invalid({"n": True}, schema) and invalid({"m": 3}, schema) and invalid({"l": [1]}, schema) and invalid([], schema)


# --- urls


def test_url_rules(spark):
    urls = ["http://a.example.org/es/1", "http://EXAMPLE.ORG/en/17?x", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#f", "http://com/de/1", "http://notexample.org/es/", "http://org", "no scheme", None, "http://x.net/", "x://a.org/b://c.com/de/"]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id int, url string").withColumns({"host": F.lit("h"), "key": F.lit("k")})
    got = {r.page_id: r for r in url_filter(pages, rules_frame(spark)).collect()}
    assert [got[i].rule for i in range(12)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", "com/de/", "org/", None, None, None, None, "org/"]
    assert [got[i].verdict for i in (0, 1, 2, 3, 4, 7, 9)] == ["block", "block", "allow", "allow", "block", "allow", "allow"]
    assert got[1].host == "example.org" and got[8].host == "" and got[9].path == ""
    assert url_filter(pages, rules_frame(spark)).count() == 13
    none = spark.createDataFrame([], "rule string, verdict string")
    assert {r.verdict for r in url_filter(pages, none, default="block").collect()} == {"block"}


def test_many_rules_equal_a_plain_search(spark):
    rng = random.Random(4)
    rules = {f"{rng.choice('abc')}.{rng.choice('de')}/{rng.choice(['', 'x', 'xy/', 'y'])}": rng.choice(["allow", "block"]) for _ in range(30)}
    urls = [f"http://{rng.choice(['', 'w.', 'v.w.'])}{rng.choice('abcd')}.{rng.choice('def')}/{rng.choice(['', 'x/', 'xy/z', 'yy', 'q'])}" for _ in range(400)]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules_frame(spark, rules.items())).collect()}
    for i, u in enumerate(urls):
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, key=lambda r: (len(r), len(r.split("/")[0])), default=None)
        assert got[i] == (best, rules[best] if best else "allow")


def test_a_filter_fuller_than_its_blocks_loses_nothing(spark, monkeypatch):
    from quillgraph.llm import common, url_filter as uf

    monkeypatch.setattr(uf, "MAX_BLOCKS", 1)
    rules = {f"h{i}.com/p{i}": ["allow", "block"][i % 2] for i in range(300)}
    pages = spark.createDataFrame([(i, f"http://h{i % 400}.com/p{i % 400}/x") for i in range(800)], "page_id int, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in uf.url_filter(pages, rules_frame(spark, rules.items())).collect()}
    rule = lambda i: f"h{i}.com/p{i}"
    assert got == {i: (rule(i % 400), rules[rule(i % 400)]) if i % 400 < 300 else (None, "allow") for i in range(800)}
    monkeypatch.setattr(common, "MAX_FILTER_BLOCKS", 1)
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    clear, doubt = common.split_by_ids(df, df.where("doc_id % 5 = 0"), "doc_id")
    assert {r.doc_id for r in doubt.collect()} >= set(range(0, 500, 5)) and clear.count() + doubt.count() == 500


# --- personal data


def test_surrogates(spark, odd, docs):
    rows = [(1, "Mr. Smith wrote to Frau Anna Müller, a@b.example.org and 10.0.0.1."), (2, "Mr. Smith: a@b.example.org, c@b.example.org +1 (017) 555-7713"), (3, "4111111111111111 and token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""), (4, "Госпожа Иванова"), (5, "plain words"), (5, "plain words")]
    got = {r.doc_id: r for r in pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    found = re.match(r"Mr\. (\w+) wrote to Frau (\w+) (\w+), (\S+@\S+\.example\.org) and (\d+\.\d+\.\d+\.\d+)\.$", got[1].text)
    assert found and "Smith" not in got[1].text
    again = re.match(r"Mr\. (\w+): (\S+), (\S+) (\+1 \(\d{3}\) \d{3}-\d{4})$", got[2].text)
    assert again[1] == found[1] and again[2] == found[4] and again[3] != again[2]
    card, secret = re.match(r'(\d{16}) and token = "([0-9a-f]{40})"$', got[3].text).groups()
    digits = [int(c) for c in card[::-1]]
    assert (sum(digits[::2]) + sum(d * 2 - 9 * (d > 4) for d in digits[1::2])) % 10 == 0 and secret[:8] != "04dbebab"
    assert re.match(r"Госпожа [А-Я][а-я]+$", got[4].text) and got[5].text == "plain words" and got[5].n_entities == 0
    assert pseudonymize(odd, "key").count() == len(ODD) and pseudonymize(empty(docs), "key").count() == 0


def test_surrogates_are_distinct_where_room_is_small(spark):
    ents = spark.createDataFrame([(f"a{i}@{c}.org",) for i in range(10) for c in "bcdef"], "entity string")
    got = surrogates(ents, "key").toPandas()
    assert got.surrogate.is_unique and not set(got.surrogate) & set(got.entity)


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = cp.quality_stage(spark, docs, sf)
    kept = kept.cache()
    assert kept.columns == docs.columns
    once = cp.exact_dedup_stage(spark, kept, sf).cache()
    squeezed = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in once.collect()]
    everything = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()}
    assert len(squeezed) == len(set(squeezed)) and set(squeezed) == everything
    near = cp.near_dedup_stage(spark, once, sf).cache()
    groups = defaultdict(set)
    for i, _, c in brute_components([(r.doc_id, r.text) for r in once.collect()]):
        groups[c].add(i)
    assert {r.doc_id for r in near.collect()} == set(groups)
    mixed = cp.mixing_stage(spark, near, sf)
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == set(groups) and mixed.columns == docs.columns
    assert cp.tokens_stage(spark, near, sf).count() == len(groups)


def test_batches_to_workers_are_bounded_by_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "64m")
        docs = spark.range(0, 60, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 100000)").alias("text"))
        got = encode_decode(docs, model_path())

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

        seen = docs.mapInArrow(sizes, "size long, n long").collect()
        assert sum(r.n for r in seen) == 60 and max(r["size"] for r in seen) < 6_000_000
        assert got.where("size(ids) > 1").count() == 60
        spark.conf.set(name, "1m")
        encode_decode(docs, model_path())
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.set(name, before)
