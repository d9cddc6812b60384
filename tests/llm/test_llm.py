"""Operators against brute force on the smallest documents table, with edge rows added."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from flowmill.llm import bpe, components, jaccard, kneser, language, media, packing, pii, quality, queries, suffix, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, key long, shard int"


def edge_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(160)]
    rows = [(9000, None), (9001, ""), (9002, " \n\t "), (9003, "one"), (9004, "two words"), (9004, "two words"), (9005, "a\x1cb\x1d c  d\n\n\n e"), (9006, "x" * 3000), (9007, "ü§漢字 🙂 ab́c " * 40), (None, "no id here at all"), (None, None)]
    for i in range(12):  # near copies with one to three changed words
        own = list(base)
        for j in range(i % 4):
            own[rng.randrange(160)] = f"n{i}x{j}"
        rows.append((9100 + i, " ".join(own)))
    rows += [(9200 + i, "the of " + " ".join(f"s{i % 2}{j}" for j in range(30))) for i in range(6)]  # small sets
    rows += [(9300, "Long passage that repeats. " * 9 + "tail one"), (9301, "head " + "Long passage that repeats. " * 9), (9302, "<|endoftext|> it's I'm 12345   end")]
    rows.append((9400, " ".join(rng.choice(words) for _ in range(20000))))
    return rows


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    own = spark.createDataFrame([(i, t, None, None, None, "clash", 1, 2) for i, t in edge_rows()], SCHEMA)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(own, allowMissingColumns=True).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([], docs.schema).write.parquet(f"{top}/none/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{top}/none/conversations.parquet")
    return top


@pytest.fixture(scope="session")
def docs(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def rows_of(spark, folder, name):
    return queries.QUERIES[name](spark, folder).collect()


def expect(rows, wanted):
    """Equal multisets of tuples."""
    assert Counter(map(tuple, rows)) == Counter(wanted)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_empty_table(spark, folder, name):
    found = rows_of(spark, f"{folder}/none", name)
    assert [r.conv_id for r in found] == [-1] if name == "op12_chat" else found == []  # op12 adds a conversation of its own


def test_pipeline_on_empty_table(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []


def test_media(spark, folder, docs):
    rows = rows_of(spark, folder, "op1_media")
    wanted = []
    for i, t in docs:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        wanted.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    expect([tuple(r)[:5] for r in rows], wanted)


def test_codecs():
    assert media.ulaw_table()[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    payload = bytes(range(256)) * 2
    for codec in media.CODECS:
        name, back, blocks = media.read_container(media.container(codec, payload))
        assert (name, back) == (codec, payload)
    # the block decoder against one sample at a time
    blocks = np.random.default_rng(1).integers(0, 256, (5, 36)).astype(np.uint8)
    got = media.decode_adpcm(blocks)
    for b, out in zip(blocks, got):
        value = int.from_bytes(b[:2].tobytes(), "little", signed=True)
        index, want = min(int(b[2]), 88), [value]
        for x in b[4:].tolist():
            for code in (x & 15, x >> 4):
                step = media.STEPS[index]
                d = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + media.INDEX_STEPS[code & 7]))
                want.append(value)
        assert out.tolist() == want


def test_packing(spark, folder, docs):
    rows = rows_of(spark, folder, "op2_packing")
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    wanted = []
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[at : at + 2048], "<u4")
            wanted.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
    expect([tuple(r)[:5] for r in rows], wanted)
    check_bins(rows, 2048)


def check_bins(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_exchange_and_bounds(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 900)
    table = spark.createDataFrame([(i, 0, int(x)) for i, x in enumerate(lengths)], "doc_id long, piece int, length long")
    rows = packing.pack(table, 100, per_partition=60).collect()
    assert len(rows) == 900
    assert check_bins(rows, 100) <= 1.05 * packing.lower_bound(lengths, 100)
    for _ in range(50):  # bounds never exceed the best packing of small cases
        few = rng.integers(1, 11, 6)
        best = min(greedy(order, 10) for order in itertools.permutations(few.tolist()))
        assert packing.lower_bound(few, 10) <= best <= packing.best_fit_decreasing(few, 10)[0].max() + 1
    with pytest.raises(ValueError):
        packing.pack(table.withColumn("length", F.lit(101)), 100)


def greedy(order, capacity):
    bins, room = 1, capacity
    for x in order:
        if x > room:
            bins, room = bins + 1, capacity
        room -= x
    return bins


def brute_components(docs, n, num, den):
    sets = []
    for _, t in docs:
        w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(docs)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
            both = len(a & b)
            if den * both >= num * (len(a) + len(b) - both):
                up[find(j)] = find(i)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(i)
    out = []
    for own in groups.values():
        ids = [docs[i][0] for i in own if docs[i][0] is not None]
        out += [(docs[i][0], len(sets[i]), min(ids, default=None)) for i in own]
    return out


def test_jaccard(spark, folder, docs):
    expect(rows_of(spark, folder, "op3_jaccard"), brute_components(docs, 3, 9, 10))


def test_jaccard_of_the_pipeline(spark, folder, docs):
    rows = jaccard.jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"), 5, (4, 5)).drop("set_id", "root", "row_key").collect()
    expect(rows, brute_components(docs, 5, 4, 5))


def test_subset_boundary_is_exact():
    for num, den in ((9, 10), (4, 5), (1, 2)):
        t = jaccard.Threshold(num, den)
        for depth in (1, 2):
            b = t.boundary(depth)
            links = [(x, y) for i in range(1, b + 2) for x in range(9) for y in range(9) if den * i >= num * (i + x + y) and x + y > depth and max(i + x, i + y) <= b]
            assert not links


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200), (None, 3)]
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    expect(got.collect(), [(i, 0) for i in range(41)] + [(i, 100) for i in (100, 101, 102)])


def test_bpe(spark, folder, docs):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t in docs:
        ids = own.encode_ordinary(t or "")
        wanted.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    expect(rows_of(spark, folder, "op4_bpe"), wanted)


def test_bpe_decode(spark):
    df = spark.createDataFrame([(1, bytearray(np.array([0, 5, 300], "<u4").tobytes())), (2, None), (3, bytearray())], "doc_id long, ids binary")
    path = P.path("byte_bpe_multi_50k.tiktoken")
    table = {r: t for t, r in bpe.read_ranks(path).items()}
    expect([(r.doc_id, None if r.decoded is None else bytes(r.decoded)) for r in bpe.decode_ids(df, path).collect()], [(1, table[0] + table[5] + table[300]), (2, None), (3, b"")])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, folder, docs, rule):
    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    df = spark.createDataFrame([(i, x, [3, None, 8, 8]) for i, x in docs], "doc_id long, text string, ends array<int>")
    for ends_col in (None, "ends"):
        got = token_counts.count_tokens(df, path, rule, ends_col=ends_col).collect()
        wanted = []
        for i, text in docs:
            text = text or ""
            ends = token_counts.section_ends(text, None if ends_col is None else [3, None, 8, 8]).tolist()
            edges = [0, *ends]
            n, crossing = [0] * len(ends), [0] * len(ends)
            section = lambda c: min(next((k for k, e in enumerate(ends) if c < e), len(ends) - 1), len(ends) - 1)
            for a, b in t.encode(text, add_special_tokens=False).offsets:
                b = max(b, a + 1)
                lo, hi = section(a), section(b - 1)
                k = lo
                if rule == "end":
                    k = hi
                elif rule == "most":
                    k = max(range(len(ends)), key=lambda s: (min(b, edges[s + 1]) - max(a, edges[s]), -s))
                n[k] += 1
                crossing[k] += lo != hi
            wanted += [(i, k, edges[k], edges[k + 1], n[k], crossing[k]) for k in range(len(ends))]
        expect(got, wanted)


def test_quality(spark, folder, docs):
    wanted = []
    for i, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        wanted.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    rows = rows_of(spark, folder, "op6_quality")
    expect([tuple(r)[:7] for r in rows], wanted)
    assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def test_quality_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    found = con.execute(queries.ORACLE_SQL["op6_quality"])
    names = [x[0] for x in found.description]
    expect(spark.createDataFrame(rows_of(spark, folder, "op6_quality")).select(*names).collect(), found.fetchall())


def test_pii_patterns():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("ab@..12345+-( )0%é\n") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == brute_pii(text), text
    assert pii.base_spans("a@b.c@d.e x@y 4111 1111 1111 1111 300.1.1.1.2.3") == brute_pii("a@b.c@d.e x@y 4111 1111 1111 1111 300.1.1.1.2.3")


def test_pii_query(spark, folder, docs):
    rows = rows_of(spark, folder, "op7_pii")
    wanted = []
    for i, t in docs:
        spans = brute_pii(t or "")
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        wanted.append((i, n[0], n[1], n[2], n[3], hashlib.sha256(text.encode()).hexdigest()))
    expect([tuple(r)[:6] for r in rows], wanted)


def test_random_field():
    field = pii.train()
    table = pii.labelled_table()
    got = pii.viterbi(field.scores([w for w, _ in table]), field.move)
    right = sum(pii.LABELS[x] == y for (_, tags), own in zip(table, got) for x, y in zip(own, tags))
    assert right / sum(len(t) for t in table for t in [t[1]]) > 0.97
    # Viterbi against all label sequences
    rng = np.random.default_rng(2)
    move = rng.normal(size=(3, 3))
    scores = [rng.normal(size=(n, 3)) for n in (1, 4, 3)]
    for s, own in zip(scores, pii.viterbi(scores, move)):
        value = lambda y, s=s: sum(s[i, k] for i, k in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
        assert value(own.tolist()) == pytest.approx(max(value(y) for y in itertools.product(range(3), repeat=len(s))))
    texts = ["ring me at (555) 203-4567 tonight", "there were 12 of 340 people"]
    found = pii.added_spans(texts, [pii.base_spans(t) for t in texts], field)
    assert [[t[a:b] for a, _, b in x] for t, x in zip(texts, found)] == [["(555) 203-4567"], []]


def test_kneser_ney(spark, folder, docs):
    rows = rows_of(spark, folder, "op8_kneser_ney")
    tokens = lambda t: [x.encode().lower() for x in WORD.findall(t or "")] + [None]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count, pairs = Counter(), Counter()
    for i, t in docs:
        if not out(i):
            own = tokens(t)
            count.update(own)
            pairs.update(zip(["<"] + own, own))
    n, v = sum(count.values()), len(count)
    context, kinds, cont = Counter(), defaultdict(Counter), Counter()
    for (a, b), c in pairs.items():
        context[a] += c
        kinds[a][min(c, 3)] += 1
        cont[b] += 1
    of = lambda values: kneser.discounts(*(sum(c == k for c in values) for k in (1, 2, 3, 4)))
    d, e = of(pairs.values()), of(cont.values())
    spare = sum(e[min(c, 3) - 1] for c in cont.values())
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0

    def p(a, b):
        low = (cut(cont[b], e) + spare / (v + 1)) / len(pairs)
        if not context[a]:
            return low
        return (cut(pairs[a, b], d) + sum(d[k - 1] * kinds[a][k] for k in (1, 2, 3)) * low) / context[a]

    assert sum(p("<", b) for b in [*count, "unseen"]) == pytest.approx(1, abs=1e-6)
    wanted = defaultdict(list)
    for i, t in docs:
        own = tokens(t)
        wanted[i].append((len(own), sum(count[x] > 0 for x in own), sum(np.log10((count[x] + 1) / (n + v + 1)) for x in own), sum(np.log10(p(a, b)) for a, b in zip(["<"] + own, own))))
    for r in rows:
        assert r.held_out == out(r.doc_id) and r.train_tokens == n
        assert any((r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2]) and r.score == pytest.approx(w[3]) for w in wanted[r.doc_id])


@pytest.mark.parametrize("order", (3, 4))
def test_kneser_ney_of_higher_order(spark, order):
    rng = random.Random(5)
    train = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(12))) for _ in range(60)] + [None]
    asked = ["a b c d", "", "f e zz a b", "zz", "a b"]
    tokens = lambda t: ["<", *(t or "").split(), None]
    raw = [Counter(tuple(own[i : i + m]) for own in map(tokens, train) for i in range(len(own) - m + 1)) for m in range(order + 1)]
    counts = {order: raw[order]}
    for m in range(order - 1, 0, -1):
        left = Counter(g[1:] for g in raw[m + 1])
        counts[m] = {g: raw[m][g] if g[0] == "<" else left[g] for g in raw[m] if g != ("<",)}
    v = len(counts[1])
    of = {m: kneser.discounts(*(sum(c == k for c in counts[m].values()) for k in (1, 2, 3, 4))) for m in counts}

    def p(context, w):
        m = len(context) + 1
        c = {g[-1]: c for g, c in counts[m].items() if g[:-1] == context}
        low = p(context[1:], w) if context else 1 / (v + 1)
        if not c:
            return low
        cut = {x: min(n, of[m][min(n, 3) - 1]) for x, n in c.items()}
        back = sum(of[m][min(n, 3) - 1] for n in c.values())
        return (c.get(w, 0) - cut.get(w, 0) + back * low) / sum(c.values())

    model = kneser.train(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    got = kneser.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    for r in got:
        own = tokens(asked[r.doc_id])
        assert r.score == pytest.approx(sum(np.log10(p(tuple(own[max(0, i - order + 1) : i]), own[i])) for i in range(1, len(own))))


def brute_repeats(docs, length=100):
    first = {}
    order = sorted(docs, key=lambda x: -(1 << 63) if x[0] is None else x[0])
    for i, t in order:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], (i, k))
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] != (i, k):
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, folder, docs):
    expect(rows_of(spark, folder, "op9_suffix_dedup"), brute_repeats(docs))


def test_suffix_dedup_of_large_groups(spark):
    rng = random.Random(11)
    passage = " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(40))
    docs = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(200))) + passage[rng.randrange(60) :] + "".join(rng.choice("pq") for _ in range(rng.randrange(90)))) for i in range(60)]
    docs += [(i, "ab" * 150) for i in (100, 101)] + [(200, "z" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for large in (2, 10_000):
        got = suffix.remove_repeats(df, large=large).select("doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
        expect(got, brute_repeats(docs))


def test_suffix_dedup_of_repeated_and_missing_ids(spark):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    twice, shared, other = text(300), text(150), text(400)
    docs = [(1, twice), (1, twice), (2, shared + text(80)), (2, text(70) + shared), (3, "x" + twice), (4, other), (4, text(250))]
    docs += [(None, text(60) + other[:120]), (None, text(500)), (None, shared), (None, text(40) + shared), (5, other), (5, other)]
    schema = "doc_id long, text string"
    for large in (2, 10_000):
        got = suffix.remove_repeats(spark.createDataFrame(docs, schema), large=large).select("doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256)).collect()
        expect(got, brute_repeats(docs))
    rows = [(i, t, "en", "web", len(t or "")) for i, t in docs[:2]]
    left = corpus_pipeline.suffix_stage(spark, spark.createDataFrame(rows, f"{schema}, lang string, source string, n_chars long"), "").collect()
    assert [(r.doc_id, r.text) for r in left] == docs[:2]


def test_language(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = rows_of(spark, folder, "op10_language")
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang is not None and len(docs[r.doc_id].text or "") > 60]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.85 * len(held)
    for r in rows:
        text = docs[r.doc_id].text if r.doc_id is not None else None
        assert 0 <= r.score <= 1
        if text is not None and not any(c.isalpha() for c in text):
            assert r.lang_pred == "und"


def test_language_viterbi():
    rng = np.random.default_rng(4)
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)) * 3
    got, at = language.viterbi(scores, counts, 1.5), 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda y, own=own: sum(own[i, k] for i, k in enumerate(y)) - 1.5 * sum(a != b for a, b in zip(y, y[1:]))
        if n:
            assert value(got[at : at + n].tolist()) == pytest.approx(max(value(y) for y in itertools.product(range(3), repeat=int(n))))
        at += n


def test_pipeline(spark, folder):
    top = spark.read.parquet(f"{folder}/documents.parquet")
    names = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r[0] for r in top.select("doc_id").collect()}
        top = corpus_pipeline.cut(stage(spark, top, folder), name)
        after = {r[0] for r in top.select("doc_id").collect()}
        assert after <= before
        names = names or top.columns
        if name != "packing":
            assert top.columns == names
        if name == "near_duplicates":
            assert 9200 in after and 9201 in after and not {9202, 9203, 9204, 9205} & after
    check_bins(top.collect(), 2048)
    assert json.dumps(top.columns)


def test_parities_bound_how_much_sets_differ(spark):
    rng = np.random.default_rng(5)
    rows, most = [], []
    for size in (1, 200, 256, 257, 500, 513, 1030):
        x = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
        for extra in (0, 3, 40, 600):
            y = np.unique(np.concatenate([x[extra // 2 :], rng.integers(0, 1 << 63, extra).astype(np.uint64)]))
            rows.append((len(rows), jaccard.parity(x).tolist(), jaccard.parity(y).tolist()))
            most.append(len(np.setxor1d(x, y)))
    pairs = spark.createDataFrame(rows, "i long, x array<long>, y array<long>")
    found = {r.i: r.d for r in pairs.select("i", jaccard.least_differing(pairs.x, pairs.y).alias("d")).collect()}
    assert all(found[i] <= n for i, n in enumerate(most))
    assert all(found[i] == 0 for i, n in enumerate(most) if n == 0)
    assert all(found[i] >= n / 2 for i, n in enumerate(most) if i % 4 < 3)  # of sets that differ little most is seen
