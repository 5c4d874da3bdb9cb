"""Each operator on small rows with nulls, empty texts, repeats, long texts, clashing columns, and no rows at all, against brute force."""

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fernquery.llm import chat, decontaminate, elias_fano, mixing, ngram_lm, quality_model, quality_rules, simhash, toxicity, url_rules, warc

BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
TEXTS = [
    (1, BASE, "a"), (2, BASE, "a"), (2, BASE, "a"), (3, None, "b"), (4, "", None), (5, "one two", "b"), (6, BASE + " end", None), (7, LONG, "a"), (None, "no id " + BASE, "b"), (8, "É " + BASE.upper() + "!! \u00a0 x", "c"),
    (9, "same line here\nsame line here\nother\n\n" + "go go go go go go " * 12, "c"), (10, "  lead\ttrail \n", "c"),
]
SCHEMA = "doc_id long, text string, source string"
EXTRA = ("term", "part", "fp", "h", "pos", "b_id", "g_id", "words", "score", "_id", "size", "codes")


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(TEXTS, SCHEMA)
    return frame.withColumns({c: F.lit("clash") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# --- 1


def _hits(text, windows):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    hit, items = set(), set()
    for win, own in windows.items():
        for s in range(len(w) - len(win) + 1):
            if tuple(w[s : s + len(win)]) == win:
                hit |= set(range(s, s + len(win)))
                items |= own
    return len(w), len(hit), tuple(sorted(items))


def test_decontaminate(spark, docs, empty):
    tests = [(1, BASE[20:90]), (2, "one TWO"), (3, None), (4, ""), (5, "w3x3 w4x4"), (6, "one two"), (7, "never there at all"), (8, BASE)]
    bench = spark.createDataFrame(tests, "item_id long, text string").withColumn("term", F.lit("clash"))
    windows = defaultdict(set)
    for i, t in tests:
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        for s in range(max(1, len(w) - 9)) if w else []:
            windows[tuple(w[s : s + 10])].add(str(i))
    got = [(r[0], r[1], r[2], tuple(r[3])) for r in rows(decontaminate.contamination(docs, bench), "doc_id", "n_words", "n_hit", "items")]
    assert got == sorted(((i, *_hits(t, windows)) for i, t, _ in TEXTS), key=repr)
    assert rows(decontaminate.clean_documents(docs, bench), "doc_id", "text") == sorted(((i, t) for i, t, _ in TEXTS if not _hits(t, windows)[1]), key=repr)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect())


def test_decontaminate_in_blocks_and_by_proximity(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(1, BASE), (2, "tau upsilon"), (3, "alpha gamma")], "item_id long, text string")
    whole = rows(decontaminate.contamination(docs, bench), "doc_id", "n_hit", "items")
    monkeypatch.setattr(decontaminate, "BLOCK", 3)
    monkeypatch.setattr(decontaminate, "MAX_VOCABULARY", 0)
    monkeypatch.setattr(decontaminate, "MAX_DOCUMENTS", 0)
    assert rows(decontaminate.contamination(docs, bench), "doc_id", "n_hit", "items") == whole
    index = decontaminate.postings(docs.select(F.col("doc_id").alias("doc"), F.lit(0).cast("long").alias("part"), "text"), None)
    tests = decontaminate.phrases(bench, "item_id", "text", 10).filter(F.array_contains("items", "3"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    near = decontaminate.proximity_matches(index, tests, counts, 3)
    assert {r["doc"] for r in near.filter("doc is not null").collect()} == {1, 2, 6, 8}
    assert decontaminate.proximity_matches(index, tests, counts, 1).filter("stop - start <> 2").count() == 0


# --- 2, 10


def test_toxicity_learns_and_takes_anything(spark, docs, empty):
    bad = [(i, f"you {['idiot', 'moron'][i % 2]} of number {i}", 1) for i in range(100, 160)]
    good = [(i, f"a kind note of number {i} to you", 0) for i in range(160, 260)]
    train = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    labels = train.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (100, None), (100, 1)], "doc_id long, toxic int"))
    model = toxicity.learn(train, labels, F.lit(True))
    scored = train.select("toxic", toxicity.score_all(train, model).alias("score")).collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in scored)
    assert all(0 <= r["s"] <= 1 for r in docs.select(toxicity.score_all(docs, model).alias("s")).collect())
    assert empty.select(toxicity.score_all(empty, model)).count() == 0
    none = toxicity.learn(empty, labels.limit(0), F.lit(True))
    assert docs.select(toxicity.score_all(docs, none).alias("s")).filter("s > 0.01").count() == 0
    assert toxicity.fit(["a", "b"], np.array([1, 1])).bias > 0


def test_quality_learns_and_takes_anything(spark, docs, empty):
    bad = [(i, "| ".join(f"q{j}" for j in range(i % 7 + 20)), 0) for i in range(60)]
    good = [(i, f"words of a story number {i} that goes on and on. Then it ends.", 1) for i in range(60, 160)]
    train = spark.createDataFrame(bad + good, "doc_id long, text string, quality int")
    model = quality_model.learn(train, train.select("doc_id", "quality"), F.lit(True))
    right = train.select("quality", quality_model.score_all(train, model).alias("s")).collect()
    assert np.mean([(r["s"] >= 0.5) == (r["quality"] == 1) for r in right]) > 0.95
    assert all(0 <= r["s"] <= 1 for r in docs.select(quality_model.score_all(docs, model).alias("s")).collect())
    assert quality_model.learn(empty, train.select("doc_id", "quality"), F.lit(True)).scores(["x"])[0] < 0.01


def test_context_vectors_equal_brute_force(spark, docs):
    texts = [t or "" for _, t, _ in TEXTS]
    places, signs = quality_model.index_places()
    want = np.zeros((1 << quality_model.BITS, quality_model.WIDTH))
    from fernquery.llm import tokens

    for t in texts:
        h, _ = tokens.word_and_sign_tokens([t])
        w = (h >> np.uint64(64 - quality_model.BITS)).astype(int)
        for i in range(len(w)):
            for j in range(max(0, i - 2), min(len(w), i + 3)):
                if i != j:
                    for k in range(quality_model.ONES):
                        want[w[i], places[w[j], k]] += signs[w[j], k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality_model.context_vectors(docs), want, atol=1e-5)


# --- 3


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,)])
def test_mixing(docs, weights):
    got = mixing.mix(docs, weights=weights).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert rows(mixing.mix(docs, weights=weights), "doc_id", "size") == sorted(((i, size(t)) for i, t, _ in TEXTS), key=repr)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    assert sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    for own in by.values():
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= mixing.PACKET + 1
        assert own[0]["target"] <= 3 * own[0]["source_size"] + 1e-6
    assert rows(mixing.mix(docs.repartition(5), weights=weights), "doc_id", "taken") == rows(mixing.mix(docs, weights=weights), "doc_id", "taken")


def test_targets_share_the_excess():
    t = mixing.targets({"a": 100, "b": 10, None: 90}, [5, 2, 1], 1.0, 3)
    assert t["b"] == 30 and abs(t["a"] + t[None] - 170) < 1e-9 and abs(t["a"] / t[None] - 5) < 1e-9


def test_mixing_nothing(empty):
    assert mixing.mix(empty).count() == 0


# --- 4


def _print(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _classes(pairs):
    out = {}
    for i, p in pairs:
        out.setdefault(p, set()).add(i)
    prints, root = list(out), {p: p for p in out}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in prints:
        for b in prints:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    low = defaultdict(list)
    for p in prints:
        low[find(p)] += [i for i in out[p] if i is not None]
    return {p: min(low[find(p)], default=None) for p in prints}


def test_simhash(docs, empty):
    prints = [(i, _print(t)) for i, t, _ in TEXTS]
    classes = _classes(prints)
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(((i, f"{p:016x}", classes[p]) for i, p in prints), key=repr)
    kept = rows(simhash.one_of_each(docs), "doc_id", "text")
    assert len(kept) == len(set(classes[p] for _, p in prints))
    assert simhash.near_duplicates(empty).count() == 0


def test_leaders_join_what_all_pairs_join(spark):
    words = [f"w{i}" for i in range(120)]
    texts = []
    for g in range(6):
        base = [f"g{g}{w}" for w in words]
        texts += [" ".join([*base[: 3 * k], f"new{g}x{k}", *base[3 * k + 1 :]]) for k in range(15)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, texts[0] + " more")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, max_bits=7, segments=4, similarity=0.8).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    prints, root = [_print(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(texts)):
        for b in range(a):
            if prints[a] == prints[b] or bin(prints[a] ^ prints[b]).count("1") <= 7 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert len({find(i) for i in range(len(texts))}) < len(texts) / 2


def test_similar_texts_are_linked_however_far_their_prints(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(40, 200)))]
        for k in range(8):
            own = list(base)
            for at in rng.choice(len(base), int(rng.integers(0, 1 + len(base) // 25)), replace=False):
                own[at] = f"new{k}x{at}"
            texts.append(" ".join(own + [f"tail{g}x{k}x{i}" for i in range(int(rng.integers(0, len(base) // 10)))]))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, max_bits=None, similarity=0.8).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    prints, root = [_print(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            far += similar and bin(prints[a] ^ prints[b]).count("1") > 7
            if prints[a] == prints[b] or similar:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert far
    assert [got[i] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_near_duplicates_stage_looks_fingerprints_up_first(spark, monkeypatch):
    """The stage links through the multi-index what is within its bits; the join of shingle sets is left with the rest, and nothing is lost."""
    import corpus_pipeline

    rng = np.random.default_rng(9)
    texts = []
    for g in range(10):
        base = [f"g{g}w{i}" for i in range(int(rng.integers(60, 300)))]
        for k in range(6):
            own = list(base)
            for at in rng.choice(len(base), int(rng.integers(0, 1 + len(base) // 40)), replace=False):
                own[at] = f"new{k}x{at}"
            texts.append(" ".join(own + [f"tail{g}x{k}x{i}" for i in range(int(rng.integers(0, len(base) // 20)))]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    prints, root = [_print(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    close, far = set(), 0
    for a in range(len(texts)):
        for b in range(a):
            similar = len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if similar and bin(prints[a] ^ prints[b]).count("1") <= 7:
                close.add(frozenset((prints[a], prints[b])))
            elif similar:
                far += 1
            if prints[a] == prints[b] or similar:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    looked, joined = [], []
    near, similar_links = simhash.near_pairs, simhash.similar_links

    def looking(*args, **options):
        looked.append(near(*args, **options))
        return looked[-1]

    def joining(texts, shingle, least, known=None):
        joined.append(known)
        return similar_links(texts, shingle, least, known)

    monkeypatch.setattr(simhash, "near_pairs", looking)
    monkeypatch.setattr(simhash, "similar_links", joining)
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates_stage(spark, frame, "").collect()}
    assert close and far
    assert kept == {find(i) for i in range(len(texts))}
    assert looked and looked[0].count() > 0
    assert [known is not None and known.count() > 0 for known in joined] == [True]
    pairs = {frozenset(p % (1 << 64) for p in (r["a"], r["b"])) for r in looked[0].collect()}
    assert all(bin(x ^ y).count("1") <= 7 for x, y in pairs) and pairs & close


@pytest.mark.parametrize("bits,segments", [(2, 2), (7, 4), (5, 3)])
def test_near_pairs_equal_brute_force(spark, bits, segments):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    prints = {b ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 9)), replace=False)) for b in base for _ in range(12)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bits, segments).collect()
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits}
    assert sorted((r["a"], r["b"]) for r in got) == sorted(want)


# --- 5


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://b/", "<p>é</p>"), (4, "u", ""), (None, "n", "<p>é</p>"), (5, "long", "x" * 3_000_000), (6, "r", "twice"), (6, "r", "twice")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("sha", F.lit("clash"))
    found = warc.read_archives(warc.archive(frame), payloads=True).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    want = [("1", len("<p>é</p>".encode()), "response", None), ("2", 0, "response", None), ("3", 9, "revisit", "1"), ("4", 0, "revisit", "2"), ("null", 9, "revisit", "1"), ("5", 3_000_000, "response", None), ("6", 5, "response", None), ("6", 5, "response", None)]
    assert sorted((r["page"], r["bytes"], r["type"], r["refers_to"]) for r in found) == sorted((a, b, c, d) for a, b, c, d in want)
    assert {r["digest"] for r in found} == {digest(h) for _, _, h in pages}
    assert next(r for r in found if r["page"] == "5")["payload"] == b"x" * 3_000_000
    assert warc.read_archives(warc.archive(frame.limit(0))).count() == 0


@pytest.mark.parametrize("harm", [lambda b: b[:-3], lambda b: b[4:], lambda b: b[: len(b) // 2] + bytes([b[len(b) // 2] ^ 255]) + b[len(b) // 2 + 1 :], lambda b: b + b"rest"])
def test_warc_refuses_damage(tmp_path, harm):
    path = f"file://{tmp_path}/a.warc.zst"
    warc.write_archive(path, warc.train([b"few"]), iter([warc.block("response", "1", b"u", b"body" * 50, warc.sha1_base32(b"body" * 50), None)] * 3))
    assert [r["page"] for r in warc.read_archive(path)] == ["1"] * 3
    (tmp_path / "a.warc.zst").write_bytes(harm((tmp_path / "a.warc.zst").read_bytes()))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(path))


# --- 6


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<", "[[INST]]", "a\nb", None, "", "[/TURN] [ROLE] x", "</s</s>>"]
    turns = [(1, k, ["user", "assistant"][k % 2], t) for k, t in enumerate(nasty)] + [(2, 0, "assistant", "first"), (3, 0, "tool </s>", "x"), (3, None, None, "y"), (None, 0, "system", "s"), (None, 1, "user", "u"), (None, 2, "assistant", "a")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).repartition(3)
    got = {r["conv"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    own = defaultdict(list)
    for c, t, role, text in turns:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    for c, parts in own.items():
        said = [(r, t) for _, _, r, t in sorted(parts)]
        learnt = "".join(t for r, t in said if r == "assistant")
        assert got[c]["n_turns"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert {c: got[c]["valid"] for c in got} == {1: True, 2: False, 3: False, None: True}
    assert chat.read_back(chat.format_chats(frame.limit(0))).count() == 0


# --- 7


def test_url_rules(spark):
    from fernquery.llm.contracts import URL_RULES

    urls = [
        (1, "http://X.Example.ORG/es/a?b#c", "example.org/es/", "block"), (2, "https://example.org/en/12", "example.org/en/1", "block"), (3, "ftp://notexample.org/es/", "org/", "allow"), (4, "http://org", None, "allow"), (5, None, None, "allow"), (6, "no scheme", None, "allow"),
        (7, "http://a.com/de/x", "com/de/", "block"), (8, "http://a.com?x=/de/", None, "allow"), (9, "a://b://c/", None, "allow"), (10, "", None, "allow"), (11, "http://É.COM/fr/", "com/fr/", "allow"),
    ]
    spam = [(100 + i, f"http://spam{i % 3}.net/buy/{i}", None, "block") for i in range(30)]
    fine = [(200 + i, f"http://site{i % 3}.net/read/{i}", None, "allow") for i in range(30)]
    every = urls + spam + fine
    pages = spark.createDataFrame([(i, u) for i, u, _, _ in every], "page_id long, url string").withColumn("term", F.lit("clash"))
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(25)] + [(200 + i, 1, 0) for i in range(25)], "doc_id long, quality int, toxic int")
    got = rows(url_rules.judge(pages, labels, rules=URL_RULES, min_support=0.1), "page_id", "rule", "verdict")
    assert got == sorted(((i, r, v) for i, _, r, v in every), key=repr)
    assert url_rules.judge(pages, labels.limit(0)).filter("verdict = 'block'").count() == 0
    assert url_rules.judge(pages.limit(0), labels).count() == 0


# --- 8


def _lm(texts, train):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    u, b, t = Counter(), Counter(), Counter()
    for x in train:
        w = tok(x)
        u.update(w), b.update(zip(w, w[1:])), t.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(u.values()), len(u), ngram_lm.DISCOUNT
    b, t = ({k: c for k, c in x.items() if c >= 2} for x in (b, t))
    m1, m2 = defaultdict(float), defaultdict(float)
    for k, c in b.items():
        m1[k[0]] += c - d
    for k, c in t.items():
        m2[k[:2]] += c - d
    p1 = lambda w: (u[w] + 1) / (n + v + 1)
    p2 = lambda a, w: p1(w) if a not in m1 else max(b.get((a, w), 0) - d, 0) / u[a] + (1 - m1[a] / u[a]) * p1(w)
    p3 = lambda a, c, w: p2(c, w) if (a, c) not in m2 else max(t.get((a, c, w), 0) - d, 0) / b[a, c] + (1 - m2[a, c] / b[a, c]) * p2(c, w)
    for x in texts:
        w = tok(x)
        yield len(w), sum(u[k] > 0 for k in w), sum(math.log10(p1(k)) for k in w), sum(math.log10(p1(k) if i == 0 else p2(w[0], k) if i == 1 else p3(w[i - 2], w[i - 1], k)) for i, k in enumerate(w))


@pytest.mark.parametrize("shard", [1 << 21, 7])
def test_language_model(docs, empty, shard):
    source = docs.filter("doc_id is null or doc_id <> 7") if shard == 7 else docs
    model, scored = ngram_lm.train_and_score(source.select("doc_id", "text", "score"), F.col("doc_id") % 2 == 0, shard=shard)
    own = [(i, t) for i, t, _ in TEXTS if shard != 7 or i != 7]
    want = dict(zip([i for i, _ in own], _lm([t for _, t in own], [t for i, t in own if i is not None and i % 2 == 0])))
    for r in scored.collect():
        n, known, base, full = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (n, known)
        assert abs(r["base_score"] - base) < 1e-6 * n and abs(r["score"] - full) < 0.03 * n
    assert ngram_lm.train_and_score(empty.select("doc_id", "text"), F.lit(True))[1].count() == 0
    unseen = ngram_lm.train_and_score(docs.select("doc_id", "text"), F.lit(False))[1].collect()
    assert all(r["n_known"] == 0 and r["score"] == 0 for r in unseen)


@pytest.mark.parametrize("shard", [1 << 20, 3, 1])
def test_language_model_keeps_all_ngrams(spark, shard):
    texts = ["a b c d", "a b e a b f a b g a c a d", "c d a a b a a e a f a b c a b d", "b a x a b z a b e"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, scored = ngram_lm.train_and_score(frame, F.col("doc_id") < 3, min_count=1, shard=shard)
    u, b, t = Counter(), Counter(), Counter()
    for x in texts[:3]:
        w = [*x.split(), None]
        u.update(w), b.update(zip(w, w[1:])), t.update(zip(w, w[1:], w[2:]))
    n, v, d = sum(u.values()), len(u), ngram_lm.DISCOUNT

    def smooth(grams, total, context, word, lower):
        own = {k: c for k, c in grams.items() if k[:-1] == context}
        if not own:
            return lower
        return max(own.get((*context, word), 0) - d, 0) / total + (1 - sum(c - d for c in own.values()) / total) * lower

    def p(w, i):
        out = (u[w[i]] + 1) / (n + v + 1)
        out = out if i == 0 else smooth(b, u[w[i - 1]], (w[i - 1],), w[i], out)
        return out if i < 2 else smooth(t, b[w[i - 2], w[i - 1]], (w[i - 2], w[i - 1]), w[i], out)

    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    for k, x in enumerate(texts):
        w = [*x.split(), None]
        assert abs(got[k] - sum(math.log10(p(w, i)) for i in range(len(w)))) < 0.03 * len(w)
    cut = [len({(s.first) for s in model.shards[n]}) < len(model.shards[n]) for n in (2, 3)]
    assert cut == [shard < 4, shard < 4]  # a context's successors are in several shards


def test_elias_fano():
    rng = np.random.default_rng(1)
    for universe, n in ((1 << 63, 1000), (100, 50), (10**12, 70_000), (1000, 999), (5, 0), (1 << 40, 1)):
        v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        s = elias_fano.Sequence(elias_fano.pack(v, universe, searched=True))
        assert (s.get(np.arange(len(v))) == v).all() and (s.range(len(v) // 3, len(v)) == v[len(v) // 3 :]).all()
        plain = elias_fano.Sequence(elias_fano.pack(v, universe))
        assert (plain.get(np.arange(len(v))) == v).all()
        ask = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
        place = {int(x): i for i, x in enumerate(v)}
        assert (s.find(ask) == np.array([place.get(int(x), -1) for x in ask])).all()


# --- 9


def _rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {p for i, g in enumerate(zip(w, w[1:], w[2:])) if tri[g] >= 2 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(docs, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert rows(quality_rules.judge(docs), *names) == sorted(((i, *_rules(t)) for i, t, _ in TEXTS), key=repr)
    failed = {r["doc_id"]: r["base_failed"] for r in quality_rules.judge(docs).collect()}
    assert failed == {i: (m := _rules(t))[0] < 50 or 100 * m[4] > 50 * m[0] for i, t, _ in TEXTS}
    assert quality_rules.judge(empty).count() == 0


def test_common_lines_deplete(spark):
    plain = lambda i: " ".join(f"own{i}word{j}" for j in range(60))
    shared = "\n".join(" ".join(f"shared{k}word{j}" for j in range(12)) for k in range(6))
    frame = spark.createDataFrame([(i, f"{shared}\n{plain(i) if i >= 40 else f'tail{i}'}", "h") for i in range(80)] + [(i, plain(i), "h") for i in range(100, 120)] + [(300 + i, shared, "other") for i in range(3)] + [(400, None, None)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge(frame).collect()}
    assert all(got[i]["depleted"] and not got[i]["kept"] for i in range(40))
    assert all(got[i]["kept"] and got[i]["common_words"] == 72 for i in range(40, 80))
    assert all(got[i]["kept"] and got[i]["common_words"] == 0 for i in [*range(100, 120), 300, 301, 302])
    assert {r["doc_id"] for r in quality_rules.kept_documents(frame).collect()} == {i for i in got if got[i]["kept"]}


def test_common_lines_are_cut(spark):
    own = lambda i: " ".join(f"own{i}word{j}" for j in range(60))
    texts = [(i, f"{own(i)}\n  Share\tTHIS page \n\nlast {i}\nshare this page", "h") for i in range(30)]
    frame = spark.createDataFrame([*texts, texts[0], (None, texts[1][1], "h"), (50, texts[0][1], "other"), (51, own(51), "h")], SCHEMA).select("source", "text", "doc_id")
    kept = quality_rules.kept_documents(frame)
    assert kept.columns == frame.columns
    cut = lambda i: f"{own(i)}\n\nlast {i}"
    want = [(i, cut(i), "h") for i in range(30)] + [(0, cut(0), "h"), (None, cut(1), "h"), (50, texts[0][1], "other"), (51, own(51), "h")]
    assert rows(kept, "doc_id", "text", "source") == sorted(want, key=repr)


# --- checks against brute force


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = np.random.default_rng(11)
    baskets = []
    for i in range(90):
        items = {f"t{j}" for j in range(7) if rng.random() < 0.55}
        if i % 3 == 0:
            items = {"u0", "u1", "u2", "u3", "u4"} - ({f"u{i // 3 % 5}"} if i % 12 else set())
        baskets.append((sorted(items), bool(len({"u0", "u1", "u2", "u3", "u4"} & items) == 5 or {"t1", "t4"} <= items and rng.random() < 0.9)))
    got = url_rules.mine(spark.createDataFrame(baskets, "items array<string>, blocked boolean"), 0.05, 0.7).collect()
    terms = sorted({t for items, _ in baskets for t in items})
    rules = []
    for n in range(1, 8):
        for c in combinations(terms, n):
            held = [y for items, y in baskets if set(c) <= set(items)]
            if held and sum(held) >= 0.05 * len(baskets) and sum(held) / len(held) >= 0.7 and not any(set(r) <= set(c) for r in rules):
                rules.append(c)
    assert sorted(tuple(r["terms"]) for r in got) == sorted(rules)
    assert max(map(len, rules)) >= 5


def test_ngrams_do_not_depend_on_windows(monkeypatch):
    text = "  Some  text with\u00a0odd\tspaces, É and ẞ ΣΑΣ " * 30 + "x" * 400 + " end"
    whole = np.sort(np.concatenate(list(toxicity.ngrams(text))))
    plain = " " + " ".join(text.lower().split()) + " "
    assert len(whole) == sum(len(plain) - n + 1 for n in toxicity.ORDERS)
    monkeypatch.setattr(toxicity, "_WINDOW", 37)
    assert (np.sort(np.concatenate(list(toxicity.ngrams(text)))) == whole).all()
    assert (toxicity.features(text) == np.unique(whole)).all() and len(toxicity.features("")) == 0


def test_prints_do_not_depend_on_windows(monkeypatch):
    text = b" a b\tc d e\nf g " * 50 + b"long" * 40
    whole = simhash.simhash(text), [g for part in simhash._grams(text, 3) for g in part]
    monkeypatch.setattr(simhash, "_WINDOW", 5)
    assert (simhash.simhash(text), [g for part in simhash._grams(text, 3) for g in part]) == whole
    assert simhash._grams(b"a", 3) and list(simhash._grams(b" a  b ", 3)) == [[b"a b"]] and list(simhash._grams(b"  ", 3)) == []


def test_signatures_allow_every_similar_pair(spark):
    """Texts of a few and of many words, changed a little and a lot; unlike pairs of both lengths are ruled out."""
    from fernquery.llm import set_similarity as sim

    texts = []
    for size in (30, 900, 4000):
        words = [f"w{size}x{i}" for i in range(size)]
        texts += [" ".join(words), " ".join(words[: -size // 10]), " ".join(words[:: -1]), " ".join([*words[: size // 2], *(f"v{i}" for i in range(size // 2))])]
    sets = sim._prefixes(spark.createDataFrame(list(enumerate(texts)), "part long, text string"), 5, 0.8)
    pairs = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    kept = {tuple(r) for r in sim._allowed(spark.createDataFrame(pairs, "a long, b long"), sets, 0.8).collect()}
    own = [set(sim.shingle_set(t.encode(), 5).tolist()) for t in texts]
    alike = {(a, b) for a, b in pairs if len(own[a] & own[b]) >= 0.8 * len(own[a] | own[b])}
    assert len(alike) >= 3 and alike <= kept
    assert not {(4, 6), (8, 10)} & kept
