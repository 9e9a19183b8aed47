"""Operators 11 to 13 against brute force, SQL and the libraries, with awkward inputs."""

import hashlib
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loamwork.llm import _charmap, alignment, intervals, pieces

D = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b\n\n c \t d\r\n e", "▁x y", "<s> <|endoftext|> <0x0A>", "é  　x\x85 y\x1c z  ", "𝔘日本語ひらがな \x00", "x" * 3000 + " " + "ab" * 2000, "don't  I'll\n\n\n", "Ａ①㍿ ﬁ ½  é 　 x​­ ｶﾞ "]
CLICKS = "ts timestamp_ntz, client_id long, kind string, slot string"
SALES = "sale_id long, client_id long, status string, sold_at timestamp_ntz, number int"
LINES = "sale_id long, shipped_at timestamp_ntz"


# 11


def same_as_sql(spark, clicks, sales, lines):
    got = intervals.overlap_totals(sales, lines, clicks)
    columns = sorted(got.columns)
    c = duckdb.connect()
    c.execute("CREATE TABLE clicks (ts TIMESTAMP, client_id BIGINT, kind VARCHAR)")
    c.execute("CREATE TABLE sales (sale_id BIGINT, client_id BIGINT, status VARCHAR, sold_at TIMESTAMP)")
    c.execute("CREATE TABLE sale_lines (sale_id BIGINT, shipped_at TIMESTAMP)")
    for name, df, cols in (("clicks", clicks, ["ts", "client_id", "kind"]), ("sales", sales, ["sale_id", "client_id", "status", "sold_at"]), ("sale_lines", lines, ["sale_id", "shipped_at"])):
        if rows := [tuple(r) for r in df.select(*cols).collect()]:
            c.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(cols))})", rows)
    want = c.execute(f"SELECT {', '.join(columns)} FROM ({intervals.SQL})").fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want, key=repr)
    return want


def test_interval_totals_on_tables(spark):
    assert len(same_as_sql(spark, *(spark.read.parquet(f"{D}/{x}.parquet") for x in ("clicks", "sales", "sale_lines")))) > 1000


def brute(clicks, sales, lines):
    """All pairs in plain Python: (sale_id, relation, n, slots, crc)."""
    epoch = datetime(1970, 1, 1)
    us = lambda t: (t - epoch) // timedelta(microseconds=1)
    width, by_client = 6 * 3600 * 10**6, defaultdict(list)
    for ts, client, kind, *_ in clicks:
        if ts and client is not None:
            by_client[client].append((us(ts), kind == "error"))
    sessions = defaultdict(list)
    for client, found in by_client.items():
        run = []
        for at, error in sorted(found) + [(None, False)]:
            if run and (at is None or at - run[-1][0] > 15 * 60 * 10**6):
                is_open = any(e for t, e in run if t == run[-1][0])
                sessions[client].append((run[0][0], run[0][0] // width, None if is_open else run[-1][0] // width))
                run = []
            run.append((at, error))
    out = defaultdict(lambda: [0, 0, 0])
    order = lambda x, y: (x > y) - (x < y)
    for sale, client, status, sold, *_ in sales:
        if sold is None or client is None:
            continue
        ends = [us(sold), *(us(t) for s, t in lines if s == sale and s is not None and t)]
        a, b = us(sold) // width, float("inf") if status == "open" else max(ends) // width
        for first, s, e in sessions[client]:
            e = float("inf") if e is None else e
            if s <= b and a <= e:
                name = list(intervals.RELATIONS.values())[(order(a, s) + 1) * 3 + order(b, e) + 1]
                row = out[sale, name]
                row[0] += 1
                shared = min(b, e) - max(a, s) + 1
                row[1] = None if shared == float("inf") else row[1] + shared
                row[2] += zlib.crc32(str(first).encode())
    return {(s, r, *v) for (s, r), v in out.items()}


def test_interval_totals_by_hand(spark):
    rng = np.random.default_rng(5)
    start = datetime(1969, 12, 30)
    when = lambda: None if rng.random() < 0.05 else start + timedelta(minutes=int(rng.integers(0, 6000)), microseconds=int(rng.integers(0, 2)))
    client = lambda: None if rng.random() < 0.05 else int(min(rng.integers(0, 8), 2))
    clicks = [(when(), client(), [None, "error", "view"][rng.integers(0, 3)], "x") for _ in range(900)]
    clicks += clicks[:50]
    sales = [(None if k % 17 == 3 else k, client(), [None, "open", "done"][rng.integers(0, 3)], when(), 1) for k in range(200)]
    lines = [(None if rng.random() < 0.1 else int(rng.integers(0, 250)), when()) for _ in range(400)]
    sales = [s for s in sales if s[0] is not None]
    made = [spark.createDataFrame(*x) for x in ((clicks, CLICKS), (sales, SALES), (lines, LINES))]
    same_as_sql(spark, *made)
    got = {tuple(r) for r in intervals.overlap_totals(made[1], made[2], made[0]).select("sale_id", "relation", "n_pairs", "overlap_slots", "sessions_crc").collect()}
    assert got == brute(clicks, sales, lines)
    assert {r[1] for r in got} == set(intervals.RELATIONS.values())


def test_interval_totals_of_nothing_and_of_rows_without_id(spark):
    none = [spark.createDataFrame([], x) for x in (CLICKS, SALES, LINES)]
    assert intervals.overlap_totals(none[1], none[2], none[0]).count() == 0
    clicks = spark.createDataFrame([(datetime(2024, 1, 1), 1, "view", "x")], CLICKS)
    sales = spark.createDataFrame([(None, 1, None, datetime(2024, 1, 1), 0)] * 2 + [(5, 1, "open", datetime(2024, 1, 1), 0)], SALES)
    rows = sorted(((r.sale_id, r.relation, r.n_pairs, r.overlap_slots) for r in intervals.overlap_totals(sales, none[2], clicks).collect()), key=repr)
    assert rows == [(5, "started_by", 1, 1), (None, "equals", 1, 1), (None, "equals", 1, 1)]


def test_times_with_a_zone(spark):
    zoned = spark.createDataFrame([(datetime(2024, 1, 1), 1, "view", "x")], CLICKS).withColumn("ts", F.expr("to_timestamp('2024-01-01T01:00:00+01:00')"))
    assert intervals.click_sessions(zoned).collect()[0]["first"] == 1704067200_000000


# 12


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_normalisation_through_a_compiled_map(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, add_dummy_prefix=True, remove_extra_whitespaces=True)
    spec = next(v for k, v in _charmap.fields(library.serialized_model_proto()) if k == 3)
    own = _charmap.Normalizer(spec, False, [])
    for text in ODD:
        out, begins, ends = own.normalise(text.encode())
        assert out.decode() == library.normalize(text)
        assert len(begins) == len(ends) == len(out) and (begins <= ends).all() and (np.diff(begins) >= 0).all()
    out, begins, ends = own.normalise("a㍿ b".encode())
    assert [(chr(c), b, e) for c, b, e in zip(out[:4], begins[:4], ends[:4]) if c < 128] == [("a", 0, 1)]
    assert set(zip(begins[4:-4].tolist(), ends[4:-4].tolist())) == {(1, 4)}  # four characters come from one of three bytes


def test_user_symbols_stay_and_win(spark):
    own = _charmap.Normalizer(b"", False, [b"<a>", b"<a> b"])
    assert own.normalise(b"x  <a> b<a>")[0].decode() == "▁x▁<a>▁b<a>"


def test_pieces_equal_the_library_and_cover_the_text(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (2, ODD[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("z"))
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    by = {r.doc_id: r for r in pieces.encoded(docs, PIECES).collect()}
    assert by[None].ids == [1, 2] and pieces.encoded(docs.limit(0), PIECES).count() == 0
    for k, text in enumerate(ODD):
        r, data = by[k], text.encode()
        assert r.ids == sp.encode(text, add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
        spans = list(zip(r.begins, r.ends))
        assert spans[0] == (0, 0) and spans[-1] == (len(data), len(data))
        assert b"".join(data[b:e] for b, e in spans) == data  # nothing but spaces changes in this model
        for i, (b, e) in zip(r.ids[1:-1], spans[1:-1]):
            piece = sp.id_to_piece(i)
            assert data[b:e] == bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else data[b:e].decode().replace(" ", "▁") in (piece, piece[1:])


def test_piece_query(spark):
    got = {r.doc_id: r for r in pieces.query(spark, D).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for r in spark.read.parquet(f"{D}/documents.parquet").collect():
        ids = sp.encode(r.text, add_bos=True, add_eos=True)
        g = got.pop(r.doc_id)
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert not got


# 13


def aligned_by_hand(rows):
    t, sp = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte = {(chr(b) if b in set(shown) else chr(next(rest))): b for b in range(256)}
    of_a = {i: bytes(byte[c] for c in s) for s, i in t.get_vocab().items() if all(c in byte for c in s)}
    of_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    own, df = [], Counter()
    for doc, text in rows:
        links, groups, a, b = Counter(), [], [], []
        if text:
            a, b, whole = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text), (" " + text).encode()
            if b"".join(map(of_a.get, a)) != whole or b"".join(map(of_b, b)) != whole:
                a, b = [], []
            ends_a, ends_b = np.cumsum([len(of_a[i]) for i in a]).tolist(), np.cumsum([len(of_b(i)) for i in b]).tolist()
            low = 0
            for end in sorted({*ends_a} & {*ends_b}):
                groups.append(tuple([i for i, e in zip(x, ends) if low < e <= end] for x, ends in ((a, ends_a), (b, ends_b))))
                low = end
            links.update((x, y) for g in groups for x in g[0] for y in g[1])
        df.update(links.keys())
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        own.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    best = Counter()
    for (x, _), n in df.items():
        best[x] = max(best[x], n)
    return [(d, a, b, g, sum(m.values()), sum(n for p, n in m.items() if df[p] == best[p[0]]), sum(n * df[p] for p, n in m.items()), s) for d, a, b, g, m, s in own]


def test_alignment_against_whole_texts(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (None, "same text"), (None, "same text"), (77, "日本語" * 400)]
    rows += [(r.doc_id, r.text[:1500]) for r in spark.read.parquet(f"{D}/documents.parquet").limit(40).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("batch", F.lit(1)).withColumn("part", F.lit("z")).repartition(5)
    want = sorted(aligned_by_hand(rows), key=repr)
    assert sorted(map(tuple, alignment.aligned(docs, BYTES, PIECES).collect()), key=repr) == want
    assert alignment.aligned(docs.limit(0), BYTES, PIECES).count() == 0


def test_cuts_are_verified():
    v = alignment.Vocabularies.of(BYTES, PIECES)
    assert v.cuts == " \n\t"
    assert v._merge_across("\r", v.bytes_b) and not v._merge_across(" ", [b"  x", b" \n "]) and v._merge_across(" ", [b"a b"])
    for text in ODD:
        found = v.pattern().findall(" " + text)
        assert "".join(found) == " " + text
        a, b = v.tokens(found)
        assert [i for x in a for i in x] == v.a.encode(" " + text, add_special_tokens=False).ids or "▁" in text


def test_large_groups_are_counted_by_their_different_ids(spark, monkeypatch):
    v = alignment.Vocabularies.of(BYTES, PIECES)
    texts = [" ".join(ODD[2:8]) + "𝔘日" * 50]
    segments = list(dict.fromkeys(s for t in texts for s in v.pattern().findall(" " + t)))

    def pairs():
        import pyarrow as pa

        given = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([alignment.packed(np.arange(len(segments), dtype=np.int32))]), pa.array([segments])], ["batch", "codes", "segments"])
        al = alignment.Aligned(pa.Table.from_batches(list(alignment._align(iter([given]), BYTES, PIECES))), v)
        return al.pairs.tolist(), al.often.tolist(), al.pair_of.tolist(), al.n_pairs.tolist(), al.links.tolist()

    whole = pairs()
    monkeypatch.setattr(alignment, "LINKS_TOGETHER", 3)
    assert pairs() == whole


# 2 and 10


def test_training_rows_are_bounded_where_doc_ids_repeat(spark):
    from loamwork.llm import toxicity

    rows = [(i % 20, f"word{i} {'vile' if i % 2 else 'fine'} text {i % 7}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, label int")
    counts = toxicity.character_counts(docs)
    seen = []
    real = toxicity._logistic
    toxicity._logistic = lambda x, y: seen.append(len(x)) or real(x, y)
    try:
        toxicity.learn(docs, labels, counts, 30)
    finally:
        toxicity._logistic = real
    assert seen and seen[0] <= 30


def test_vectors_of_extreme_magnitude(spark):
    from loamwork.llm import ann

    rows = [(0, [1e200, 1.0]), (50, [1e200, 2.0]), (3, [1e-200, 1e-200]), (4, [0.0, 0.0]), (100, [-1e-200, 3e-200])]
    got = {(r.query_id, r.vec_id): r.score for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert set(got) == {(q, v) for q in (0, 50, 100) for v in (0, 50, 3, 100) if q != v}
    assert got[0, 50] == 1.0 and abs(got[0, 3] - 0.5**0.5) < 1e-12 and abs(got[100, 3] - 2 / 20**0.5) < 1e-12
