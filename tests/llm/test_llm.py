"""Operators of the llm subpackage against brute force, exact round trips, held-out accuracy, and awkward inputs."""

import hashlib
import io
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loamwork.llm import _eliasfano, _graph, _tokens, _words, ann, decontam, licenses, neardup, ngramlm, packing, quality, substrings, tokenfile, toxicity

D = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALNUM, SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [(1, None, "x", 0), (2, "", None, 1), (3, "a b c", "x", None), (3, "a b c", "x", None), (4, long, "x", 2), (5, long, "x", 2), (None, "no id here", "x", 3), (6, "é" * 50 + " \x00 tail\r\n", "x", 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, bands string, score long").withColumn("n", F.lit(1)).withColumn("anchor", F.lit("z"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


def test_words_match_the_patterns(texts):
    values = [*list(texts.values())[:40], None, "", "A\x0bB\x85C ñÑ 9z_x", "x"]
    for kind, pattern, change in (("alnum", ALNUM, low), ("space", SPACE, lambda s: s or ""), ("space_lower", SPACE, low)):
        w = _words.split(pa.array(values, pa.string()), kind)
        vocab = [v.as_py().decode() for v in w.vocab]
        for k, t in enumerate(values):
            assert [vocab[c] for c in w.codes[w.bounds[k] : w.bounds[k + 1]]] == pattern.findall(change(t))


def test_tokens_equal_the_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    values = [*list(texts.values())[:60], "", "x <|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|> c", "Don't STOP’s ’q’, É İΣ ½ <|endoftext|> 日本 ok\x1fq\x85r ́a≠ (x)é"]
    ids, at = _tokens.Encoder.of(TOKENIZER).encode(pa.array(values))
    for k, v in enumerate(values):
        assert ids[at[k] : at[k + 1]].tolist() == t.encode(v, add_special_tokens=False).ids


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)] + [(200, 200 + i) for i in range(30)]
    got = {r.node: r.class_id for r in _graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (90, 95, 100)} == {90} and {got[200 + i] for i in range(30)} == {200}
    assert _graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def shingles(t):
    w = SPACE.findall(t or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark, docs, texts):
    base = " ".join(f"w{i}" for i in range(300))
    near = [(9001 + k, base.replace(f"w{7 * k + 3} ", f"edit{k} ")) for k in range(40)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(rows).collect()}
    every = texts | dict(near)
    assert set(got) == set(every)
    assert {got[i] for i, _ in near} == {9001}
    sets = {i: shingles(t) for i, t in every.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for n, b in enumerate(h) for a in h[:n])
    for (a, b), c in common.items():
        j = c / (len(sets[a]) + len(sets[b]) - c)
        assert j < 0.8 or got[a] == got[b]
        assert j > 0.6 or got[a] != got[b] or a in dict(near)


def test_near_duplicates_odd(odd, spark):
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(odd).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, None: None}
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_classes(rows, threshold=0.8):
    """Class of each distinct text: links by weighted Jaccard similarity of all pairs, and how many links there are."""
    words = [SPACE.findall(t) for t in rows]
    df = Counter(w for x in words for w in set(x))
    idf = {w: 1 + math.log(min(max(len(rows) / n, 1), neardup.RARE)) / math.log(neardup.RARE) for w, n in df.items()}
    bags = []
    for x in words:
        bag = defaultdict(float)
        for i in range(max(1, len(x) - 4) if x else 0):
            bag[tuple(x[i : i + 5])] += np.mean([idf[w] for w in x[i : i + 5]])
        bags.append(bag)
    classes, links = list(range(len(rows))), 0
    find = lambda i: i if classes[i] == i else find(classes[i])
    for j in range(len(rows)):
        for i in range(j):
            both = sum(min(v, bags[j][g]) for g, v in bags[i].items() if g in bags[j])
            if both and both >= threshold * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                links += 1
                classes[find(j)] = find(i)
    return [find(i) for i in range(len(rows))], links


def test_near_duplicates_against_all_pairs(spark):
    """Copies with few and many edits, chains, and texts that have a long passage in common but are not near: classes equal those of all pairs."""
    rng = np.random.default_rng(8)
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [f"{' '.join(f'own{k}x{i}' for i in range(30))} {passage}" for k in range(60)]
    rows += [f"{' '.join(f'few{k}x{i}' for i in range(9))} {passage}" for k in range(25)]
    for f in range(12):
        words = [f"fam{f}w{rng.integers(40)}" for _ in range(90)]
        for e in range(7):
            copy = list(words)
            for at in rng.choice(90, e, replace=False):
                copy[at] = f"edit{rng.integers(10**9)}"
            rows.append(" ".join(copy))
    chain = [f"chain{i}" for i in range(200)]
    rows += [" ".join(chain[5 * k : 5 * k + 100]) for k in range(18)]
    order = rng.permutation(len(rows))
    rows = [rows[i] for i in order]
    want, links = brute_classes(rows)
    assert links > 40 and len(set(want)) > 70
    got = {r.doc_id: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    low = {}
    for i, c in enumerate(want):
        low.setdefault(c, i)
    assert [got[i].class_id for i in range(len(rows))] == [low[c] for c in want]
    assert [i for i in got if got[i].first] == sorted(low.values(), key=list(got).index)


def test_word_weights(spark, docs, texts):
    weights = neardup.word_weights(docs.select("doc_id", "text"))
    df = Counter(w for t in texts.values() for w in set(SPACE.findall(t)))
    some = list(df)[::7] + ["absent"]
    got = weights.of(_words.hash_terms(pa.array([w.encode() for w in some])))
    assert np.allclose(got, [1 + math.log(min(len(texts) / max(df[w], 1), 1000)) / math.log(1000) for w in some])


@pytest.mark.parametrize("n_docs", [10**4, 10**8])
def test_idf_spread_does_not_depend_on_size(n_docs):
    share = np.array([0.5, 0.1, 0.01, 0.002])
    got = neardup.Weights(np.arange(4, dtype=np.uint64), (share * n_docs).astype(np.int64), n_docs)
    assert np.allclose(got.of(np.arange(5, dtype=np.uint64)), [*(1 + np.log(1 / share) / np.log(1000)), 2.0])


def test_meetings_lose_no_similar_pair():
    """Heads of random weighted sets against all pairs."""
    rng = np.random.default_rng(3)
    sets = []
    for f in range(40):
        base = rng.choice(400, 30, replace=False)
        for _ in range(4):
            x = base.copy()
            x[rng.choice(30, rng.integers(0, 7), replace=False)] = rng.choice(400, 1)
            x = np.unique(x)
            sets.append((x, rng.uniform(1, 2, 400)[x] if rng.random() < 0.3 else np.ones(len(x)) + x % 3))
    rows = []
    for k, (x, w) in enumerate(sets):
        order = np.argsort(x)
        rest = np.cumsum(w[order][::-1])[::-1]
        rows += [(int(x[o]), k, k % 50, w.sum(), r) for o, r in zip(order, rest, strict=True) if r >= 0.8 * w.sum() - 1e-9]
    lists, node, classes, total, rest = (np.array(c) for c in zip(*rows, strict=True))
    ones = np.ones(len(rows), bool)
    index = neardup.indexed(total, rest, 0.8)
    got = {tuple(p) for p in neardup.meetings(lists, node, classes, total, rest, index, ones, 0.8)}
    full = {tuple(p) for p in neardup.meetings(lists, node, classes, total, rest, ones, ones, 0.8)}
    assert got <= full
    near = 0
    for j in range(len(sets)):
        for i in range(j):
            if i % 50 != j % 50 and neardup.weighted_jaccard(sets[i], sets[j]) >= 0.8:
                near += 1
                assert (i, j) in got
    assert near > 20


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    w = rng.uniform(1, 3, 400)
    s = neardup.Sampler(2000)
    for share in (0.5, 0.8):
        k = int(400 * share)
        a, b = (ids[:k], w[:k]), (ids[400 - k :], w[400 - k :] * 1.2)
        order = lambda x: (np.sort(x[0]), x[1][np.argsort(x[0])])
        true = neardup.weighted_jaccard(order(a), order(b))
        assert abs((s(*a) == s(*b)).mean() - true) < 0.05


# 2


def channel():
    c = np.zeros(toxicity.N**3, np.int64)
    c += toxicity.count_trigrams(_words.split(pa.array(["the stone in the river is pure and the lost idea is a raid"]), "space_lower"))
    return toxicity.Channel(c, ["idiot", "moron", "stupid"])


@pytest.mark.parametrize(("word", "plain"), [("1d10t", "idiot"), ("m0r0n", "moron"), ("i.d.i.o.t", "idiot"), ("5tup1d", "stupid"), ("iiidiooot", "idiot"), ("ídíot", "idiot"), ("$tupid", "stupid"), ("idiot###", "idiot")])
def test_restores_disguised_words(word, plain):
    assert plain in channel().restore(word)


@pytest.mark.parametrize("word", ["stuupid", "moronn", "idiiot$$", "$$tupid", "m0r0n" + "!" * 70, "i" + "d" * 90 + "iot"])
def test_restores_doubled_and_trailing(word):
    assert {"stupid", "moron", "idiot"} & set(channel().restore(word))


def test_finds_signs_in_long_joined_words():
    counts = toxicity.count_trigrams(_words.split(pa.array(["you are so very much a stupid idiot and that is it"]), "space_lower"))
    model = toxicity.Model(counts, ["stupid", "idiot"])
    joined = ".".join("youaresoverymuchastupidandthatisallthereistosayaboutityes")
    found = model.matrix(pa.array([joined, "nothing of the kind", None]))
    assert found[0, 0] == 1 and found[1:, :2].sum() == 0


def test_decoding_is_the_cheapest_path():
    """Viterbi against all readings of short words."""
    own = channel()
    rng = np.random.default_rng(4)
    for _ in range(150):
        word = "".join(rng.choice(list("idotmrnsu013$.!5"), rng.integers(1, 7)))
        runs = [(m.group(1), len(m.group(0))) for m in re.finditer(r"(.)\1*", word)]
        paths = [("", 0.0)]
        for k, (c, n) in enumerate(runs):
            paths = [(t + x, cost + price) for t, cost in paths for x, price in own.options(c, n, 0 < k < len(runs) - 1)]

        def whole(t, cost):
            path = [0, 0, *(toxicity._NUMBER.get(x, toxicity.N - 1) for x in t), 0]
            return cost + sum(own.cost[path[i - 2]][path[i - 1]][path[i]] for i in range(2, len(path)))

        least = min(whole(t, c) for t, c in paths)
        assert min(whole(t, c) for t, c in paths if t == own.decode(word)) < least + 1e-9


def test_words_with_one_letter_twice_are_decoded_alike_at_once():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("idotmrns"), rng.integers(2, 9))) for _ in range(400)] + ['"stuupid,"', "moronn", "aab", "xx"]
    one, many = channel(), channel()
    many.learn_twice(words)
    assert len(many.cache) > 100 and all(one.decode(w) == x for w, x in many.cache.items())
    assert all(set(one.restore(w)) == set(many.restore(w)) for w in words)


def test_spelled_letters():
    w = _words.split(pa.array(["you i d i o t ok", "a b", None]), "space_lower")
    assert toxicity.spelled(w) == [(0, "idiot")]


def test_toxicity_held_out(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    got = toxicity.classify(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    y = got.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in y) / len(y) > 0.9


def test_toxicity_odd(odd, labels, spark):
    got = toxicity.classify(odd, labels.limit(0)).collect()
    assert len(got) == 8 and {r.score for r in got} == {0.5} and [r.held_out for r in got if r.doc_id is None] == [None]
    assert toxicity.classify(spark.createDataFrame([], "doc_id long, text string"), labels).count() == 0


# 3


def occurrences(text, items):
    w, hit, found = ALNUM.findall(low(text)), set(), set()
    for item, t in items:
        p = ALNUM.findall(low(t))
        n = min(10, len(p))
        for i in range(len(p) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == p[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(w), len(hit), found


def test_contamination(spark, docs, texts):
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()][:8] + [(900, "Is the of"), (901, None), (902, "?!")]
    some = docs.where("doc_id < 60")
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(some, frame).collect()}
    for i in got:
        n, hit, found = occurrences(texts[i], items)
        assert (got[i].n_words, got[i].n_hit, set(got[i]["items"])) == (n, hit, found)
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert sum(s.end - s.start for s in got[i].spans) == hit


def test_contamination_blocks_and_proximity(spark, monkeypatch):
    d = spark.createDataFrame([(1, "zeta alpha filler beta filler gamma delta " + "pad " * 40 + "one two three")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "one two three"), (3, "alpha one beta two")], "item_id long, text string")
    monkeypatch.setattr(decontam, "ITEM_BYTES", 80)
    r = decontam.contamination(d, items).first()
    assert (r.n_hit, r["items"], r.near_items) == (3, ["2"], ["1"])


def test_contamination_near_by_share(spark):
    """Edited copies against brute force; the answer does not depend on what else the index holds."""
    word = [f"word{i}" for i in range(40)]
    items = [(1, " ".join(word[:20])), (2, " ".join(word[20:])), (3, "tiny item"), (4, "the the the of")]
    edit = lambda w, step: [f"edit{i}" if i % step == 1 else x for i, x in enumerate(w)]
    rows = [
        (1, " ".join(edit(word[:20], 6))),
        (2, " ".join(x for w in edit(word[20:], 5) for x in ([w, "more"] if w.endswith("4") else [w]))),
        (3, " ".join(edit(word[:20], 2))),
        (4, " pad ".join(word[20:])),
        (5, "item so tiny of the " + "pad " * 30),
        (6, " ".join(reversed(word[:15]))),
        (7, "tiny " + "pad " * 30 + "item"),
        (8, "the " * 40),
    ]
    frame = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t in rows:
        w, found = t.split(), occurrences(t, items)[2]
        near = set()
        for k, text in items:
            p = text.split()
            need = max(min(4, len(set(p))), math.ceil(0.7 * len(set(p)) - 1e-9))
            if any(len(set(w[j : j + len(p) + 12]) & set(p)) >= need for j in range(len(w))):
                near.add(str(k))
        want[i] = sorted(near - found)
    assert want[1] == ["1"] and want[2] == ["2"] and want[3] == [] and want[5] == ["3", "4"] and want[6] == ["1"] and want[7] == []
    for more in ([], [(100, " ".join(word[::-2]) + " " + "pad " * 50)]):
        for parts in (1, 4):
            got = decontam.contamination(spark.createDataFrame(rows + more, "doc_id long, text string").repartition(parts), frame).collect()
            assert {r.doc_id: r.near_items for r in got if r.doc_id < 100} == want


def test_contamination_items_without_id(spark):
    d = spark.createDataFrame([(1, "one two three four"), (2, "five six")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "two three"), ("7", "six")], "item_id string, text string")
    got = {r.doc_id: r for r in decontam.contamination(d, items).collect()}
    assert (got[1].n_hit, got[1]["items"], got[1].items_sha256) == (2, [], hashlib.sha256(b"").hexdigest())
    assert (got[2].n_hit, got[2]["items"]) == (1, ["7"])


def test_contamination_odd(odd, spark):
    items = spark.createDataFrame([("k", "a b c"), (None, "a b c")], "item_id string, text string")
    got = decontam.contamination(odd, items).collect()
    assert len(got) == 8 and sum(r.n_hit for r in got) == 6
    assert decontam.contamination(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(odd.limit(0), items).count() == 0


# 4


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0), np.array([7]), rng.integers(0, 50_000, 5000), np.where(rng.random(3000) < 0.02, 4_000_000_000, rng.integers(0, 30, 3000)), np.full(1024, 2**32 - 1)):
        ids = ids.astype(np.uint32)
        out = io.BytesIO()
        tokenfile.write_shard(out, np.array([5]), np.array([len(ids)]), iter([ids[:700], ids[700:]]))
        raw = out.getvalue()
        shard = tokenfile.Shard(pa.BufferReader(raw))
        assert (shard.ids(0) == ids).all() and shard.total == len(ids)
        if len(ids) > 1500:
            assert (shard.span(1000, 1500) == ids[1000:1500]).all()


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in texts.items()}


def test_token_files(spark, docs, texts, tmp_path):
    folder = f"file://{tmp_path}/tok"
    got = tokenfile.read(tokenfile.write(docs, TOKENIZER, folder), folder).orderBy("doc_id").collect()
    ids, start = reference_ids(texts), 0
    assert [r.doc_id for r in got] == sorted(texts)
    for r in got:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids[r.doc_id]), zlib.crc32(ids[r.doc_id].tobytes()))
        start += r.n_tokens


def test_token_files_odd(odd, spark, tmp_path):
    folder = f"file://{tmp_path}/tok"
    got = tokenfile.read(tokenfile.write(odd, TOKENIZER, folder), folder).collect()
    assert len(got) == 8 and sum(r.n_tokens == 1 for r in got) == 2
    assert [r.start for r in got if r.doc_id is None] == [0] and -1 not in {r.doc_id for r in got}
    assert tokenfile.read(tokenfile.write(odd.limit(0), TOKENIZER, folder), folder).count() == 0


# 5


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in texts.items():
        w, places, base, every = ALNUM.findall(low(t)), [], set(), set()
        for p, label in licenses.PHRASES.items():
            q = p.split()
            at = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            places += at
            base |= {label} if at else set()
        for line in low(t).split("\n"):
            x = ALNUM.findall(line)
            for block in [x] if len(x) <= 256 else [x[s : s + 256] for s in range(0, len(x) - 128, 128)]:
                for label, templates in licenses.TEMPLATES.items():
                    for s in (set(y.split()) for y in templates):
                        if len(s & set(block)) >= math.ceil(0.8 * len(s) - 1e-9):
                            every.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | every))


def test_licenses_wrapped(spark):
    """Templates at 72 columns, plain and behind comment marks, in the midst of other lines; and words too far apart to be one."""
    import textwrap

    every = [(label, t) for label in licenses.TEMPLATES for t in licenses.TEMPLATES[label]]
    rows, want = [], {}
    for k, (label, t) in enumerate(every):
        lines = textwrap.wrap("intro filler " * 4 + t, 72 if len(t) > 72 else 30)
        for m, mark in enumerate(("", "# ", " * ", "// ")):
            rows.append((4 * k + m, "other line\n" + "\n".join(mark + x for x in lines) + "\n\nlast line"))
            want[4 * k + m] = label
    mit = licenses.TEMPLATES["mit"][1]
    rows += [(1000, "\n".join(w + " gap gap gap" for w in mit.split())), (1001, "\n".join(mit.split()[:13])), (1002, "\n".join(mit.split()[13:]))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, label in want.items():
        assert label in got[i].labels.split(",") and got[i].score == 1.0
        assert any(b.label == label and b.containment == 1.0 for b in got[i].blocks)
    assert [got[i].labels for i in (1000, 1001, 1002)] == ["", "", ""]


def test_licenses_odd(odd):
    got = licenses.scan(odd).collect()
    assert len(got) == 8 and {r.labels for r in got} == {""} and {r.score for r in got} == {0.0}
    assert licenses.scan(odd.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.Templates({"x": ["a " * 100_001]}, {})


# 6


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows.items()):
        w, gone = SPACE.findall(t or ""), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_substrings(spark, docs, texts):
    line = " ".join(f"common{i}" for i in range(30))
    more = {5000 + k: f"start{k} {line} middle {line} end{k}" for k in range(30)} | {6000: "loop " * 60, 6001: "loop " * 25}
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(more.items()), "doc_id long, text string"))
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.dedup(frame.repartition(7)).collect()}
    assert got == without_repeats(texts | more)


def test_substrings_repeated_ids_and_hot_anchors(spark, monkeypatch):
    """doc_ids that repeat with other texts and with the same one; anchors with more places than a part takes; against brute force."""
    monkeypatch.setattr(substrings, "SPLIT", 4)
    rng = np.random.default_rng(6)
    hot = [f"hot{i}" for i in range(26)]
    rows = []
    for k in range(70):
        around = [f"w{rng.integers(6)}" for _ in range(rng.integers(3, 60))]
        at = rng.integers(len(around) + 1)
        rows.append((int(rng.integers(50)), " ".join(around[:at] + hot[rng.integers(4) :] + around[at:])))
    rows += rows[:5] + [(1, None), (2, ""), (None, " ".join(hot)), (3, "a " * 70)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("kept", F.lit("x")).withColumn("row", F.lit(1))
    named = {(r.doc_id, r.text): r.h for r in frame.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()}
    want = {}
    seen = set()
    for i, t in sorted({x for x in rows if x[0] is not None}, key=lambda x: (x[0], named[x])):
        w, gone = SPACE.findall(t or ""), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        want[i, t] = " ".join(x for k, x in enumerate(w) if k not in gone)
    got = substrings.dedup(frame, carry=True).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 1000
    for r in got:
        assert r.row.text == r.row.text and r.row.doc_id == r.doc_id and (r.row.kept, r.row.row) == ("x", 1)
        assert r.kept == (" ".join(SPACE.findall(r.row.text)) if r.doc_id is None else want[r.doc_id, r.row.text])


def test_substrings_come_from_automata(monkeypatch):
    """Without occurrences that automata find nothing is removed."""
    text = b" ".join(b"w%d" % i for i in range(30))
    rows = pa.table({"anchor": pa.array([5, 5]), "salt": pa.array([-1, -1]), "doc_id": pa.array([1, 2]), "sub": pa.array([0, 0]), "start": pa.array([0, 7], pa.int32()), "text": pa.array([text, text], pa.binary())})
    assert [(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("n").to_pylist()) for b in substrings.settle(rows, 20)] == [([2], [7], [11])]
    docs = pa.table({"doc_id": pa.array([1, 2]), "sub": pa.array([0, 0]), "text": pa.array([text.decode()] * 2)})
    known = np.unique(substrings.anchors(_words.split(pa.array([text.decode()]), "space"))[2])
    run = lambda: [x for b in substrings._passages(docs, known, np.zeros((0, 2), np.int64), 0, 20, 8) for x in zip(b.column("doc_id").to_pylist(), b.column("text").is_valid().to_pylist(), strict=True)]
    assert {x for x in run() if not x[1]} == {(2, False)}
    monkeypatch.setattr(substrings.Automata, "occurrences", lambda self: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert list(substrings.settle(rows, 20)) == [] and all(x[1] for x in run())


def test_automata_in_parts_find_all(monkeypatch):
    rng = np.random.default_rng(7)
    codes = rng.integers(0, 5, 3000).astype(np.int32)
    starts, lengths = rng.integers(0, 2980, 40), rng.integers(3, 20, 40)
    monkeypatch.setattr(substrings, "AUTOMATON_WORDS", 60)
    phrase, first = substrings.Automata(codes, starts, lengths).occurrences()
    kinds = {tuple(codes[s : s + n]): 0 for s, n in zip(starts, lengths, strict=True)}
    want = Counter((k, i) for k in kinds for i in range(len(codes) - len(k) + 1) if tuple(codes[i : i + len(k)]) == k)
    assert {(tuple(codes[starts[p] : starts[p] + lengths[p]]), int(i)) for p, i in zip(phrase, first, strict=True)} == set(want)


def test_substrings_odd(odd, spark):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substrings.dedup(odd).collect()]
    first, second = (next(x for x in got if x[0] == i) for i in (4, 5))
    assert len(got) == 8 and second[1] == second[2] == 30_000 and 0 < first[2] < 30_000
    assert all(x[2] == 0 for x in got if x[0] not in (4, 5))
    assert substrings.dedup(odd.limit(0)).count() == 0


# 7


def test_packing(docs, texts):
    got = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    ids = reference_ids(texts)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert np.frombuffer(r.ids, "<u2").tolist() == ids[r.doc_id][r.start : r.start + r.length].tolist()
        assert r.ids_crc32 == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, p in by_doc.items():
        assert sum(x[1] for x in p) == len(ids[i]) == p[0][2]
        at = 0
        for start, length, _ in sorted(p):
            assert start == at
            at += length
    assert set(by_doc) == set(texts)
    total = 0
    for p in by_seq.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
        total += at
    assert total / (2048 * len(by_seq)) > 0.9


def test_packing_prefers_neighbours():
    a, b = np.arange(100, 600), np.arange(2000, 2500)
    shard = [np.append(a, 1), np.append(b, 1), np.append(b, 1), np.append(a, 1)]
    pieces = list(packing.pack_shard([x.astype("<u2") for x in shard], np.ones(3000, np.float32), 501.0, 1002))
    assert [(k, s) for k, _, _, s, _ in pieces] == [(0, 0), (3, 0), (1, 1), (2, 1)]


def test_packing_asks_with_all_terms():
    """Order of neighbours against BM25 by hand, and windows that go on to be filled by neighbours."""
    rng = np.random.default_rng(9)
    docs = [np.append(rng.integers(2, 60, rng.integers(1, 80)), 1).astype("<u2") for _ in range(150)]
    idf, mean = rng.uniform(0.1, 3, 60).astype(np.float32), 41.0
    index = packing.Index(docs, idf, mean)
    index.unused[3] = False
    want = []
    for k, d in enumerate(docs):
        tf = Counter(d.tolist())
        s = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t in set(docs[7].tolist()) if t in tf)
        want += [(-s, k)] if k != 3 else []
    got = list(index.neighbours(7))
    assert sorted(got) == sorted(k for _, k in want) and 7 in got
    score = {k: s for s, k in want}
    assert all(score[a] <= score[b] + 1e-4 for a, b in zip(got, got[1:]))


def test_packing_brings_related_documents_together(spark):
    """Pairs with a rare word in common, far apart in the table, share a sequence."""
    rng = np.random.default_rng(10)
    pair = [f"{''.join(rng.choice(list('bcdfghjklmnpqrstvwxz'), 9))}" for _ in range(60)]
    common = "the of and to in a is that for it as was with be by on not he".split()
    rows = [(k, " ".join([*rng.choice(common, 60), *[pair[k % 60]] * 8])) for k in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(12, "doc_id")
    by = defaultdict(set)
    for r in packing.pack(frame, TOKENIZER, window=256).collect():
        by[r.doc_id].add(r.sequence_id)
    assert sum(bool(by[k] & by[k + 60]) for k in range(60)) > 50


def test_packing_odd(odd):
    got = packing.pack(odd, TOKENIZER).collect()
    assert sum(r.length for r in got if r.doc_id in (1, 2)) == 2 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, None}
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


# 8


def test_elias_fano():
    rng = np.random.default_rng(2)
    for universe, n in ((1 << 64, 3000), (10**12, 5000), (700, 600), (4, 4), (9, 0)):
        v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
        s = _eliasfano.Sequence(_eliasfano.encode(v, universe))
        q = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
        place = {int(x): k for k, x in enumerate(v)}
        assert (s.values() == v).all() and s.find(q).tolist() == [place.get(int(x), -1) for x in q]


@pytest.mark.parametrize(("order", "least"), [(2, 2), (3, 2), (3, 1)])
def test_ngram_scores(spark, docs, texts, order, least):
    got = {r.doc_id: r for r in ngramlm.train_and_score(docs, order, min_count=least).collect()}
    every = {i: [*SPACE.findall(low(t)), None] for i, t in texts.items()}
    train = [t for i, t in every.items() if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = [Counter(tuple(t[k : k + n]) for t in train for k in range(len(t) - n + 1)) for n in range(1, order + 1)]
    for n in range(1, order):  # n-grams above words are kept from `least` on, and above kept ones
        counts[n] = Counter({g: c for g, c in counts[n].items() if c >= least})
    total, kinds = sum(counts[0].values()), len(counts[0])
    kept = defaultdict(float)
    for n in range(1, order):
        for g, c in counts[n].items():
            kept[g[:-1]] += (c - 0.75) / counts[n - 1][g[:-1]]

    def p(g):
        if len(g) == 1:
            return (counts[0][g] + 0.5) / (total + 0.5 * (kinds + 1))
        lower, c = p(g[1:]), counts[len(g) - 2][g[:-1]]
        return lower if not c else (1 - kept.get(g[:-1], 0)) * lower + ((counts[len(g) - 1][g] - 0.75) / c if counts[len(g) - 1][g] else 0)

    for i, t in every.items():
        r = got[i]
        base = sum(math.log10(p((w,))) for w in t)
        model = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k + 1]))) for k in range(len(t)))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(counts[0][(w,)] > 0 for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * len(t) and abs(r.score - model) < 0.08 * len(t)


def ngram_query(spark, folder, train, held):
    """Scores by the registered query of texts that are not learned from."""
    ids = {f: [i for i in range(2000) if (zlib.crc32(str(i).encode()) % 5 == 1) == f] for f in (False, True)}
    rows = [*zip(ids[False], train), *zip(ids[True], held)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r.score for r in ngramlm.query(spark, str(folder)).collect()}
    return [got[i] for i, _ in zip(ids[True], held)]


def test_ngram_query_has_contexts_of_two_words(spark, tmp_path):
    met, crossed = ngram_query(spark, tmp_path, ["a b c", "x b d"] * 20, ["a b c", "a b d"])
    assert met > crossed + 0.5  # by bigrams alone both are equal


def test_ngram_query_keeps_what_is_met_once(spark, tmp_path):
    met, crossed = ngram_query(spark, tmp_path, ["p q", "r s"], ["p q", "p s"])
    assert met > crossed + 0.2  # with n-grams from two on both are equal


def test_ngram_scores_read_ids(docs):
    """Texts are not split again to score them: their words lie in the shared folder as ids."""
    files = ngramlm.train_and_score(docs).inputFiles()
    assert files and all("trie-ids" in f for f in files)


@pytest.mark.parametrize("vocabulary", [1000, 1 << 31])
def test_ngram_lookups_span_batches(monkeypatch, vocabulary):
    """Small batches are looked up together and large ones in parts; documents stay whole, in their order, with ids of four or eight bytes."""
    trie = ngramlm.Trie(3)
    trie.vocabulary = vocabulary
    monkeypatch.setattr(ngramlm, "LOOKUPS", 100)
    rng = np.random.default_rng(8)
    every = [rng.integers(-1, 900, n) for n in [*[10] * 25, 250, *[1] * 30, 60, 60]]
    raw = pa.array([x.astype(trie.id_type).tobytes() for x in every], pa.binary())
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(every))), raw], ["doc_id", "ids"])
    got = list(ngramlm._looked_up(iter([rows.slice(0, 3), rows.slice(3, 4), rows.slice(7)]), trie))
    assert [i for r, _, _ in got for i in r.column("doc_id").to_pylist()] == list(range(len(every)))
    assert all((ids[a:b] == every[i]).all() for r, ids, at in got for i, a, b in zip(r.column("doc_id").to_pylist(), at, at[1:]))
    assert len(got) < 10 and all(len(ids) <= 100 or r.num_rows == 1 for r, ids, _ in got)


def test_ngram_shards_grow_before_they_become_many():
    assert [ngramlm._shards_above(n) for n in (0, 10**6, 68 * 10**6, 200 * 10**6, 4 * 10**9)] == [8, 8, 136, 256, 4000]


def test_mapped_arrays_keep_no_file_open(tmp_path):
    with open(tmp_path / "x", "wb") as out:
        _eliasfano.write_arrays(out, {"a": np.arange(9), "b": np.arange(3, dtype=np.uint8)})
    before = len(os.listdir("/proc/self/fd"))
    held = [_eliasfano.map_arrays(str(tmp_path / "x")) for _ in range(20)]
    assert len(os.listdir("/proc/self/fd")) == before
    assert all((h["a"] == np.arange(9)).all() and h["b"].tolist() == [0, 1, 2] for h in held)


def test_ngram_odd(odd):
    got = ngramlm.train_and_score(odd).collect()
    assert len(got) == 8 and all(r.score <= 0 and r.base_score < 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [None]
    assert ngramlm.train_and_score(odd.limit(0)).count() == 0


# 9


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels)
    y = got.join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in y) / len(y) > 0.93


def test_isotonic():
    out = quality.isotonic(np.array([10.0, 10, 0, 10]), np.array([5.0, 1, 0, 10]))
    assert (np.diff(out) >= 0).all() and out[0] == out[1] and out[3] > 0.9


def test_isotonic_is_the_least_squares_fit():
    """Pooled blocks against the minimax formula."""
    rng = np.random.default_rng(12)
    for _ in range(30):
        w = rng.integers(1, 9, 12).astype(float)
        h = np.minimum(w, rng.integers(0, 9, 12))
        share = lambda i, j: h[i : j + 1].sum() / w[i : j + 1].sum()
        fit = np.array([max(min(share(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)])
        got = quality.isotonic(w, h)
        # blocks are the fit's; each value is drawn to the prior by one row
        prior = h.sum() / w.sum()
        for v in np.unique(np.round(fit, 9)):
            own = np.abs(fit - v) < 1e-8
            assert len(np.unique(np.round(got[own], 9))) == 1
            assert abs(got[own][0] - (h[own].sum() + prior) / (w[own].sum() + 1)) < 0.35


def test_quality_scores_by_hand(spark, labels):
    """Features, ridge and calibration of the whole against plain numpy on all rows at once."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    got = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    x = quality.statistics(pa.array([r.text for r in rows])).astype(np.float64)
    z = quality.Features(x.mean(axis=0), x.std(axis=0) + 1e-6)(x)
    place = {r.doc_id: k for k, r in enumerate(rows)}
    known = quality.training_labels(labels, "quality").select("doc_id", "label", F.pmod(F.xxhash64("doc_id"), F.lit(quality.FOLDS)).alias("fold")).collect()
    at, y, fold = (np.array(c) for c in zip(*((place[r.doc_id], r.label, r.fold) for r in known), strict=True))
    solve = lambda m: np.linalg.solve(z[at[m]].T @ z[at[m]] + quality.RIDGE * np.eye(z.shape[1]), z[at[m]].T @ y[m])
    outside = np.zeros(len(at))
    for f in range(quality.FOLDS):
        outside[fold == f] = z[at[fold == f]] @ solve(fold != f)
    b = quality.bins_of(outside)
    curve = quality.isotonic(np.bincount(b, minlength=quality.BINS), np.bincount(b, weights=y, minlength=quality.BINS))
    want = curve[quality.bins_of(z @ solve(np.ones(len(at), bool)))]
    assert np.mean([abs(got[r.doc_id] - want[k]) < 1e-6 for k, r in enumerate(rows)]) > 0.98  # a score on the edge of a bin may fall either way


def test_quality_odd(odd, labels, spark):
    got = quality.classify(odd, labels).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(odd.limit(0), labels).count() == 0


# 10


def test_nearest_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = e.unionByName(e.select((F.col("vec_id") + 100_000).alias("vec_id"), "embedding", "label")).unionByName(e.limit(300).select((F.col("vec_id") + 200_000).alias("vec_id"), F.transform("embedding", lambda v: (v + F.rand(1) * 0.02).cast("float")).alias("embedding"), "label"))
    x = spark.createDataFrame(x.collect(), x.schema)
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in x.collect()}
    ids = np.array(sorted(rows))
    m = np.stack([rows[i] for i in ids])
    norm = np.linalg.norm(m, axis=1)
    got = defaultdict(list)
    for r in ann.search(x).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    asked = [i for i in ids if i % 50 == 0]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        s = m @ rows[q] / (norm * np.linalg.norm(rows[q]))
        s[ids == q] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:5]
        hit += len(set(ids[order]) & {v for v, _ in got[q]})
        assert len(got[q]) == 5 and all(abs(s[np.searchsorted(ids, v)] - c) < 1e-12 for v, c in got[q])
    assert hit / (5 * len(asked)) >= 0.9


def test_visits_come_by_distance():
    rng = np.random.default_rng(5)
    sample = rng.normal(size=(500, 8))
    index = ann.MultiIndex(sample, 8)
    counts = np.bincount(index.cells(sample), minlength=64)
    a, b = index.both(sample[:3])
    for q in range(3):
        cells = index.visits(a[q], b[q], counts, 500)
        d = [a[q][c // 8] + b[q][c % 8] for c in cells]
        assert d == sorted(d) and set(cells) == set(np.flatnonzero(counts))


def test_nearest_odd(spark):
    rows = [(0, [1.0, 0.0], "a"), (50, [1.0, 0.0], "a"), (1, [0.5, 0.5], "a"), (2, None, "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [float("nan"), 1.0], "a"), (6, [1.0], "a"), (None, [1.0, 1.0], "a"), (100, [float("inf"), 1.0], "a")]
    x = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(x).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)]
    assert ann.search(x.limit(0)).count() == 0
