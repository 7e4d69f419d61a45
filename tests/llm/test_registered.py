"""The registered queries opN and the stages, on whole small tables, against plain versions."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import chat, langid, mixing, pii, quality, queries_chat, queries_pii, topk
from quillgraph.llm.registry import queries
from quillgraph.llm.sentencepiece_bpe import Model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# --- 1


def test_op1_equals_the_library(spark, docs):
    import sentencepiece

    from quillgraph.llm.queries_tokens import model_path

    lib = sentencepiece.SentencePieceProcessor(model_file=model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in docs.collect():
        ids = [*lib.encode(r.text or ""), 2]
        want.add((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids))))
    got = queries()["op1_sentencepiece"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {tuple(r) for r in got} == want and len(got) == docs.count()


def test_long_units_equal_the_library():
    import sentencepiece

    from quillgraph.llm.queries_tokens import model_path

    lib, m, rng = sentencepiece.SentencePieceProcessor(model_file=model_path()), Model(model_path()), random.Random(8)
    pieces = [p.replace("▁", "") for p in m.normal]
    for alphabet in (pieces, "abcde.=-*#", ["a", "aa", "..", "...", "==", "-", "--", "----", "/*", "**", "\\", " " * 7]):
        for n in (30, 300, 3000, 20_000):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert m.encode([text])[0].tolist() == [*lib.encode(text), 2]


# --- 2


def plain_counts(text, buckets):
    low, c = (text or "").lower(), []
    for ch in low:
        if ch.isalpha():
            c.append(ord(ch))
        elif not c or c[-1] != 32:
            c.append(32)
    out = [0] * buckets
    shift = 32 - int(math.log2(buckets))
    for i in range(len(c)):
        h = 0
        for n in range(1, 4):
            if i + n <= len(c):
                h = (h * 0x01000193 + c[i + n - 1] + n) % 2**32
                out[h * 2654435761 % 2**32 >> shift] += 1
    return out


def test_op2_equals_a_plain_nearest_centroid(spark, docs):
    got = {r.doc_id: r for r in queries()["op2_language_id"](spark, SF).collect()}
    learned = docs.where((F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    fitted = langid.fit(learned)
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        assert got[r.doc_id].held_out == (fold(r.doc_id, 5) == 0)
        x = [math.log1p(n) * float(w) for n, w in zip(plain_counts(r.text, langid.BUCKETS), fitted.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x)) or 1.0
        sims = fitted.vectors.astype(np.float64) @ (np.array(x) / norm)
        assert abs(got[r.doc_id].score - sims.max()) < 1e-4
        near = {fitted.languages[i] for i in np.flatnonzero(sims > sims.max() - 1e-4)}
        assert got[r.doc_id].lang_pred in near


def test_language_rejection_ties_and_empty_tables(spark, docs):
    fitted = langid.fit(docs)
    odd = spark.createDataFrame([(1, "漢字仮名交じり文を書く人々の言葉"), (2, "Ελληνικά γράμματα και λέξεις"), (3, "12 34"), (4, None)], "doc_id long, text string")
    assert all(r.rejected for r in langid.identify(odd, fitted).collect())
    known = langid.identify(docs, fitted).where("NOT rejected").count()
    assert known > 0.98 * docs.count()
    assert langid.identify(docs.where("false"), fitted).count() == 0
    # two languages learned from the same texts: the first by name
    both = spark.createDataFrame([(i, "uno dos tres", lang) for i, lang in enumerate(["yy", "xx"] * 20)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(both, langid.fit(both)).collect()} == {"xx"}


# --- 3


def test_op3_is_what_training_on_the_driver_gives(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in queries()["op3_quality"](spark, SF).collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if fold(r.doc_id, 3) != 1}
    rows = []
    for r in sorted(docs.collect(), key=lambda r: str(r.doc_id)):
        if r.doc_id in known:
            idx, cnt = np.unique(quality.features(r.text), return_counts=True)
            rows.append((idx.astype(np.int32), cnt.astype(np.int32), known[r.doc_id]))
    fitted = quality.train(rows)
    for r in docs.collect():
        g = got.pop(r.doc_id)
        assert g.held_out == (fold(r.doc_id, 3) == 1) and abs(g.score - fitted.score(r.text)) < 1e-6 and g.predicted == (g.score >= 0.5)
    assert not got


def test_quality_labels_and_names(spark, docs):
    texts = docs.select("doc_id", "text").limit(40)
    ids = [r.doc_id for r in texts.collect()]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    plain = quality.fit(texts, labels([(i, int(i % 3 == 0)) for i in ids]))
    # other numbers, nulls and unknown documents teach nothing; an id labelled both ways counts as 1
    more = [(i, 7) for i in ids] + [(i, None) for i in ids] + [(10**9, 1), (None, 1)] + [(i, 0) for i in ids if i % 3 == 0]
    again = quality.fit(texts, labels([(i, int(i % 3 == 0)) for i in ids] + more))
    assert np.allclose(plain.table, again.table)
    assert quality.fit(texts.where("false"), labels([(1, 1)])).score("x") == quality.fit(texts, labels([])).score("x") == 0.5
    assert quality.fit(texts, labels([(i, 1) for i in ids])).score("x") > 0.5
    clash = texts.withColumn("score", F.lit("s"))
    with pytest.raises(ValueError, match="score"):
        quality.score(clash, plain, keep=clash.columns)
    assert quality.score(texts.where("false"), plain).count() == 0


# --- 5


@pytest.mark.parametrize("block", [3, 32_768])
def test_topk_in_blocks_of_queries(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "TILE_V", 50)
    rng = np.random.default_rng(4)
    big = rng.normal(size=(200, 9)) * rng.choice([0.01, 1, 1e6], size=(200, 1))
    big[150:] = big[:50]  # copies, which tie
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(big)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.topk(frame, F.col("vec_id") % 20 == 0, 7).collect())
    whole = [[math.floor(1024 * v) for v in x] for _, x in rows]
    want = []
    for q in range(0, 200, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[v], strict=True)), v) for v in range(200) if v != q)[:7]
        want += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert got == sorted(want)


# --- 6


def test_mixing_posteriors_equal_plain_naive_bayes(spark, docs):
    known = [(r.doc_id, r.lang) for r in docs.collect() if r.lang]
    fitted = mixing.fit_domains(docs, spark.createDataFrame(known, "doc_id long, domain string"), limit=10**6)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w]

    def bucket(w):
        h = xxhash.xxh64_intdigest(w[-2:].encode(), seed=xxhash.xxh64_intdigest(w[:2].encode(), seed=42))
        return (h - 2**64 if h >= 2**63 else h) % mixing.BUCKETS

    count = defaultdict(Counter)
    for i, lang in known:
        count[lang].update(map(bucket, words(texts[i])))
    names = sorted(count)
    assert fitted.names == names
    logs = {}
    for n in names:
        whole = sum(count[n].values()) + 0.5 * mixing.BUCKETS
        logs[n] = [math.log((count[n][b] + 0.5) / whole) for b in range(mixing.BUCKETS)]
    got = {r.doc_id: r for r in fitted.add_posteriors(docs, "text").collect()}
    for i, t in texts.items():
        ws = [bucket(w) for w in words(t)]
        s = [mixing.SHARPNESS * sum(logs[n][b] - logs[names[0]][b] for b in ws) / max(1, len(ws)) for n in names]
        e = [math.exp(v - max(s)) for v in s]
        assert got[i].tokens == len(ws) and np.allclose(got[i].p, [v / sum(e) for v in e], atol=1e-4)
    assert queries()["op6_mixing"](spark, SF).count() == len(texts)


def test_mixing_meets_targets_by_true_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    weights = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
    # learned from half of the documents, judged by all
    labels = docs.where("lang IS NOT NULL AND doc_id % 2 = 0").select("doc_id", F.col("lang").alias("domain"))
    got = mixing.mix(docs, labels, weights).groupBy("lang").agg(F.sum(F.col("mix_tokens") * F.col("mix_rate")).alias("t")).collect()
    whole = sum(r.t for r in got)
    assert all(abs(r.t / whole - weights[r.lang]) < 0.01 for r in got if r.lang)


def test_mixing_refuses_clashing_names_and_empty_tables(spark, docs):
    labels = docs.where("lang IS NOT NULL").select("doc_id", F.col("lang").alias("domain"))
    with pytest.raises(ValueError, match="mix_rate"):
        mixing.mix(docs.withColumn("mix_rate", F.lit(1)), labels)
    assert mixing.mix(docs.where("false"), labels.where("false")).count() == 0


# --- 7


def plain_chats(turns):
    """Every conversation by itself, in plain loops."""
    out = []
    for conv in sorted({t.conv_id for t in turns}):
        items = []
        for t in sorted((t for t in turns if t.conv_id == conv), key=lambda t: t.turn):
            blocks = re.findall(r"<tool_(call|result)>(.*?)</tool_\1>", t.text, re.DOTALL)
            rest = re.sub(r"<tool_(call|result)>(.*?)</tool_\1>", "", t.text, flags=re.DOTALL)
            if rest.strip() or not blocks:
                items.append({"kind": "message", "turn": t.turn, "k": 0, "role": t.role, "id": None, "json": {"role": t.role, "content": rest}, "status": "ok"})
            for k, (kind, raw) in enumerate(blocks, 1):
                try:
                    body = json.loads(raw)
                except ValueError:
                    items.append({"kind": kind, "turn": t.turn, "k": k, "role": t.role, "id": None, "json": {"type": f"tool_{kind}", "raw": raw}, "status": "malformed"})
                    continue
                item = {"kind": kind, "turn": t.turn, "k": k, "role": t.role, "id": body["id"], "body": body, "status": None}
                if kind == "result":
                    item["json"] = {"type": "tool_result", "id": body["id"], "content": body["content"]}
                else:
                    item["json"] = {"type": "tool_call", **body}
                    args, name = body["arguments"], body["name"]
                    if name == "translate":
                        item["status"] = "unknown tool"
                    elif name == "search" and not isinstance(args["limit"], int):
                        item["status"] = "arguments.limit: not integer"
                    elif name == "calculator" and args["digits"] not in (1, 2, 3):
                        item["status"] = "arguments.digits: not in enum"
                items.append(item)
        first = {}
        for x in items:
            if x["id"] is not None:
                first.setdefault((x["kind"], x["id"]), x)
        calls = {i: x for (kind, i), x in first.items() if kind == "call"}
        results = {i: x for (kind, i), x in first.items() if kind == "result"}
        refs = {i: {v["$ref"] for v in x["body"]["arguments"].values() if isinstance(v, dict)} & set(calls) for i, x in calls.items()}
        at, depth = {}, {}
        while True:
            ready = [i for i in calls if i not in at and all(r in at for r in refs[i])]
            if not ready:
                break
            for i in ready:
                free = [max(at[r], results[r]["turn"]) if r in results else at[r] for r in refs[i]]
                at[i], depth[i] = max([calls[i]["turn"], *free]), 1 + max([depth[r] for r in refs[i]], default=-1)
        for x in items:
            i, d = x["id"], 0
            x["w"] = x["turn"]
            if x["kind"] != "message":
                known = i in calls
                d = 2 * max(0, depth.get(i, 0)) + (1 if x["kind"] == "call" else 2)
                if known:
                    x["w"] = at.get(i, calls[i]["turn"]) if x["kind"] == "call" else max(x["turn"], at.get(i, calls[i]["turn"]))
                if x["status"] is None:
                    if first[x["kind"], i] is not x:
                        x["status"] = "duplicate"
                    elif x["kind"] == "result" and not known:
                        x["status"] = "orphan"
                    elif i not in at:
                        x["status"] = "cycle"
                    else:
                        x["status"] = "unanswered" if x["kind"] == "call" and i not in results else "ok"
            x["d"] = d
        items.sort(key=lambda x: (x["w"], x["d"], x["turn"], x["k"]))
        dump = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        out += [(conv, p, x["turn"], x["kind"], x["role"], x["id"], x["status"], dump(x["json"])) for p, x in enumerate(items, 1)]
    return out


def test_op7_equals_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    turns = queries_chat.with_calls(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    got = sorted(map(tuple, queries()["op7_chat_format"](spark, sf).collect()))
    want = sorted(plain_chats(turns))
    assert got == want
    assert {s for *_, s, _ in want} >= {"ok", "malformed", "unknown tool", "duplicate", "orphan", "cycle", "unanswered", "arguments.limit: not integer", "arguments.digits: not in enum"}


def test_chat_survives_odd_blocks(spark):
    call = lambda body: f"<tool_call>{body}</tool_call>"
    deep = '{"a":' * 5000 + "1" + "}" * 5000
    texts = [
        call('{"id":"a","name":{"x":1},"arguments":{}}'), call('{"id":"b","name":["search"],"arguments":{}}'),
        call(f'{{"id":"c","name":"search","arguments":{deep}}}'), call('{"id":"d","name":"search","arguments":{"query":"\\ud800"}}'),
        call('{"id":"e","name":"search","arguments":{"query":NaN}}'), call('{"id":"f","name":"search","arguments":{"query":1e999}}'),
        call('{"id":"\\udfff","name":"s\\ud800","arguments":{"\\ud800":{"$ref":"\\udfff"}}}'), call("[]"), None, "",
    ]
    frame = spark.createDataFrame([(1, i, "user", t) for i, t in enumerate(texts)] + [(None, 0, None, "x"), (None, 0, None, "x")], "conv_id long, turn long, role string, text string")
    tools = {"search": {"type": "object", "properties": {"query": {"type": "string"}}}}
    got = {(r.conv_id, r.pos): r for r in chat.format_chats(frame, tools).collect()}
    status = [got[1, i + 1].status for i in range(10)]
    assert status == ["unknown tool", "unknown tool", "malformed", "unanswered", "malformed", "malformed", "unknown tool", "malformed", "ok", "ok"]
    assert "\\ud800" in got[1, 4].json and got[1, 7].call_id == "\\udfff"
    assert [got[None, i].json for i in (1, 2)] == ['{"content":"x","role":null}'] * 2


def test_schema_keywords_and_equality():
    with pytest.raises(ValueError, match="pattern"):
        chat.check_schema({"type": "object", "properties": {"a": {"type": "string", "pattern": "x"}}})
    with pytest.raises(ValueError, match="unknown type"):
        chat.check_schema({"type": "text"})
    assert chat.invalid({"a": True}, {"properties": {"a": {"enum": [1]}}}) and not chat.invalid({"a": 1.0}, {"properties": {"a": {"enum": [1]}}})
    assert not chat.invalid({"a": 2.0}, {"properties": {"a": {"type": "integer"}}}) and chat.invalid({"a": 2.5}, {"properties": {"a": {"type": "integer"}}})


def test_a_hot_conversation_is_numbered_over_many_tasks(spark):
    rows = [(7, i % 40, f"m{i % 900}") for i in range(1500)] + [(i, t, "z") for i in range(5, 10) for t in range(3)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("user"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(turns, {}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.pos, r.turn))
    assert len(by[7]) == 1503
    for places in by.values():
        places.sort()
        assert [p for p, _ in places] == list(range(1, len(places) + 1)) and [t for _, t in places] == sorted(t for _, t in places)


# --- 9


def test_op9_replaces_what_a_plain_search_finds(spark, docs):
    sf = "/root/testdata/sf0.01"
    anyone = regex.compile(pii.ANY.replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries()["op9_pii_surrogates"](spark, sf).collect()}
    assert set(got) == set(texts)
    mapped, seen = {}, 0
    for i, text in texts.items():
        spans = [m.span() for m in anyone.finditer(text or "")]
        assert got[i].n_entities == len(spans)
        if not spans:
            assert got[i].text == text
            continue
        seen += len(spans)
        cuts = [0, *[x for s in spans for x in s], len(text)]
        pattern = "".join(re.escape(text[a:b]) if k % 2 == 0 else "(.+?)" for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
        for (a, b), new in zip(spans, re.fullmatch(pattern, got[i].text, re.DOTALL).groups(), strict=True):
            assert mapped.setdefault(text[a:b], new) == new
    assert seen > 50 and len(set(mapped.values())) == len(mapped) and not set(mapped) & set(mapped.values())
    for old, new in mapped.items():
        shape = lambda s: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", s)))
        assert shape(old) == shape(new) or re.fullmatch(r"[0-9.]+|[0-9a-f]+", old)


def test_people_share_their_names_and_addresses_their_case(spark):
    rows = [(1, "Mr. John Smith and Mr. Smith; John Smith too, but Mrs. Jones"), (2, "A@b.org, a@B.org and c@b.org"), (3, "Señora María López, Herr Hans López"), (4, "Max Planck and John. Smith")]
    got = {r.doc_id: r for r in pii.pseudonymize(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    m = re.fullmatch(r"Mr\. (\S+) (\S+) and Mr\. (\S+); (\S+) (\S+) too, but Mrs\. (\S+)", got[1].text)
    assert m[1] == m[4] and m[2] == m[3] == m[5] != m[6] and m[1].split("-")[0] in pii.NAMES["latin_m"]
    a, b, c = re.fullmatch(r"(\S+), (\S+) and (\S+)", got[2].text).groups()
    assert a == b != c
    f, l1, g, l2 = re.fullmatch(r"Señora (\S+) (\S+), Herr (\S+) (\S+)", got[3].text).groups()
    assert l1 == l2 and f.split("-")[0] in pii.NAMES["latin_f"] and g.split("-")[0] in pii.NAMES["latin_m"]
    assert got[4].text == rows[3][1] and got[4].n_entities == 0


def test_a_full_format_gets_longer_surrogates(spark):
    # every address of the form a@b.org exists already, so none is free
    letters = "abcdefghijklmnopqrstuvwxyz"
    ents = spark.createDataFrame([(f"{x}@{y}.org",) for x in letters for y in letters], "entity string")
    got = pii.surrogates(ents, queries_pii.KEY).toPandas()
    assert len(got) == 676 and got.surrogate.is_unique and not set(got.surrogate) & set(got.entity)
    assert got.surrogate.str.fullmatch(r"[a-z]{2,}@[a-z]\.org").all()


# --- the rest, and the stages


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op5_exact_topk", "op8_url_filter"])
def test_registered_queries_run(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_op10_equals_brute_force(spark, docs):
    from tests.llm.test_llm_operators import brute_components

    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = queries()["op10_ngram_jaccard"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert {tuple(r) for r in got} == want


LONG = "Lorem ipsum dolor sit amet consectetur " * 400
ODD = [
    (1, None, None), (2, "", None), (3, " \t\n", "en"), (4, "a  b c d e f", "en"), (4, "a  b c d e f", "en"), (5, "a\tb c d e f", "en"), (6, LONG, "de"),
    (7, "x" * 3000, "fr"), (8, "same id one", "en"), (8, "same id two", "en"), (None, "null id", "en"),
]
KEPT = {
    "exact_dedup": [None, 1, 3, 4, 6, 7, 8, 8],
    "near_dedup": [None, 1, 2, 3, 4, 4, 6, 7, 8, 8],
}


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_rows_and_names(spark, docs, at):
    import corpus_pipeline as cp

    name, stage = cp.STAGES[at]
    odd = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in ODD], docs.schema)
    for c in ("score", "predicted", "mix_rate", "mix_copies", "mix_tokens", "kept", "keep_id", "id", "n", "key", "component_id", "t", "lid"):
        odd = odd.withColumn(c, F.lit(f"own {c}"))
    got = stage(spark, odd, SF)
    rows = got.collect()
    ids = sorted((r.doc_id for r in rows), key=lambda i: -1 if i is None else i)
    if name == "tokens":
        assert len(ids) == len(ODD)
        empty = [r for r in rows if r.doc_id in (1, 2)]
        assert all(r.n_tokens == 1 and r.decoded_chars == 0 for r in empty)
    else:
        assert got.columns == odd.columns and all(r.mix_rate == "own mix_rate" and r.score == "own score" for r in rows)
        if name == "mixing":
            assert set(ids) == {i for i, _, _ in ODD}
        elif name == "quality":
            assert set(ids) <= {i for i, _, _ in ODD} and len([i for i in ids if i == 4]) in (0, 2)
        else:
            assert ids == KEPT[name]
    none = stage(spark, odd.where("false"), SF)
    assert none.count() == 0 and none.columns == got.columns
