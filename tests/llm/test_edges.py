"""Defined results of edge cases: repeated and null ids, clashing names, lost files, letters, held-out lines."""

import os
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from flowmill.llm import bpe, kneser, language, media, packing, pii, store, suffix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], DOCS)


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c = prose(1), prose(2), prose(3)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, prose(4)), (None, prose(5)), (None, prose(5)), (7, None), (7, None), (8, " ")]
    left = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), "")
    wanted = [(1, a), (2, b), (3, c), (None, prose(4)), (None, prose(5)), (7, None), (7, None), (8, " ")]
    assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter(wanted)


def test_suffix_stage_changes_nothing_else(spark):
    rng = random.Random(6)
    shared = "".join(rng.choice("é漢🙂äß") for _ in range(120))
    odd = [(1, "tail � kept?"), (2, "a" + shared), (3, "bé" + shared + "à z"), (4, "\n\n"), (5, None), (6, ""), (7, shared[:90] + " \t")]
    left = {r.doc_id: r.text for r in corpus_pipeline.suffix_stage(spark, documents(spark, odd), "").collect()}
    assert left == {1: "tail � kept?", 2: "a" + shared, 3: "béà z", 4: "\n\n", 5: None, 6: ""}
    for n, data in (("é".encode(), (0, 2)), ("xé".encode(), (1, 3))):
        assert suffix.whole(n, 0, len(n))[1] == len(n)
    assert suffix.whole("é漢".encode(), 1, 4) == (2, 2)


def test_smaller_positions():
    rng = np.random.default_rng(5)
    for _ in range(50):
        run = np.sort(rng.integers(0, 6, 40))
        doc, start = rng.integers(-2, 3, 40), rng.integers(0, 5, 40)
        places = list(zip(doc.tolist(), start.tolist()))
        wanted = [any(run[j] == run[i] and places[j] < places[i] for j in range(40)) for i in range(40)]
        assert suffix.has_smaller_position(run, doc, start).tolist() == wanted


def test_suffix_dedup_of_hot_grams(spark):
    passage = prose(9, 40)
    docs = [(i, prose(100 + i, 4) + passage + prose(500 + i, 3)) for i in range(80)]
    got = suffix.remove_repeats(documents(spark, docs).select("doc_id", "text"), large=3).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert kept[0] == docs[0][1] and all(passage not in kept[i] and len(kept[i]) < len(docs[i][1]) - len(passage) + 1 for i in range(1, 80))


def test_pack_with_clashing_names(spark):
    names = ["doc_id", "piece", "block", "bin", "offset", "fill", "gap", "spare", "row", "deal", "sequence_id", "certified"]
    df = spark.createDataFrame([(i % 3 or None, 0, *"abcdefghij", 1 + i % 7) for i in range(40)], ", ".join(f"{n} {'long' if n in ('doc_id', 'piece') else 'string'}" for n in names) + ", length long")
    rows = packing.pack(df, 10, per_partition=8).collect()
    assert len(rows) == 40 and {r.block for r in rows} == {"a"} and {r.deal for r in rows} == {"h"}
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 10 and len(fill) == packing.lower_bound(np.array([r.length for r in rows]), 10)
    assert packing.pack(df.limit(0), 10).count() == 0


def test_lost_store_file_is_an_error(spark, tmp_path):
    df = spark.range(1000).select(F.xxhash64("id").alias("key"), F.col("id").alias("n"))
    root, n = store.write_store(df, "lost", 2, ["n"])
    keys = np.sort(np.array([r.key for r in df.collect()], np.int64).view(np.uint64))
    assert n == 1000 and store.Store(root, 2).numbers(keys, ["n"])[0].all()
    os.unlink(f"{root}/00001.key.npy")
    with pytest.raises(FileNotFoundError):
        store.Store(root, 2).numbers(keys, ["n"])
    assert store.narrow(np.array([1, 1 << 33])).dtype == np.uint64
    with pytest.raises(Exception, match="repeats"):
        store.write_store(df.unionByName(df), "twice", 1, ["n"])


def test_counts_beyond_32_bits(spark):
    rows = [(np.array([5], "<u8").tobytes(), np.array([1], "<u4").tobytes(), np.array([7], "<u8").tobytes(), np.array([(1 << 32) - 1], "<u4").tobytes(), b"\x00")] * 3
    import pyarrow as pa

    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("lefts", "runs", "rights", "n", "begins"))})
    left, right, n, begins = kneser.unpacked(table)
    assert left.tolist() == [5] * 3 and right.tolist() == [7] * 3 and n.astype(np.int64).sum() == 3 * ((1 << 32) - 1) and not begins.any()


def test_only_letters_have_a_language(spark):
    train = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 20)], "doc_id long, text string, lang string")
    model = language.train(train)
    asked = ["½ ² Ⅷ", "①② 12_3", "", None, "the ½ cat", "x² le chat ½"]
    got = [(r.lang_pred, r.score, r.spans) for r in language.identify(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").coalesce(1), model).collect()]
    assert got[:4] == [("und", 0.0, "")] * 4 and got[4] == ("en", 1.0, "en:0:9") and got[5][0] == "fr"


#: Lines that the labelled table doesn't hold, with what is to be found.
HELD_OUT = [
    ("you can reach us on (212) 555-7788 until nine", ["(212) 555-7788"]),
    ("dial 415-555-0199 for help", ["415-555-0199"]),
    ("our desk (305) 212-9034 is closed on monday", ["(305) 212-9034"]),
    ("office number 555.201.3344 or the front door", ["555.201.3344"]),
    ("ring (718) 409-2255 and ask for the manager", ["(718) 409-2255"]),
    ("they sold 1200 boxes in 1987 and 340 later", []),
    ("pages 12 to 45 of volume 3 are missing", []),
    ("the ratio was 3.5 or 12% after 10:30", []),
    ("it rained on 2021-04-05 and 2022-11-30", []),
    ("a plain line without anything at all", []),
    ("meet @ noon with 4 of them", []),
]


def test_random_field_on_held_out_lines():
    field = pii.train()
    texts = [t for t, _ in HELD_OUT]
    found = pii.added_spans(texts, [pii.base_spans(t) for t in texts], field)
    got = [[t[a:b] for a, _, b in own] for t, own in zip(texts, found)]
    hits = sum(x in own for own, (_, wanted) in zip(got, HELD_OUT) for x in wanted)
    assert hits / sum(len(w) for _, w in HELD_OUT) >= 0.8, got
    assert hits / max(1, sum(map(len, got))) >= 0.9, got


def test_whole_lines_are_decoded():
    """A line's labels are those of the best label sequence of all its words, whatever is decoded beside it."""
    field = pii.train()
    line = "ring " + "word " * 40 + "then (212) 555-7788 " + "more " * 40 + "or 415-555-0199 now"
    base = pii.base_spans(line)
    alone = pii.added_spans([line], [base], field)[0]
    assert [line[a:b] for a, _, b in alone] == ["(212) 555-7788", "415-555-0199"]
    texts = ["no 12", line, "x" * 5000 + " 1", line + "\n" + line]
    many = pii.added_spans(texts, [pii.base_spans(t) for t in texts], field)
    assert many[1] == alone and sorted(many[3]) == sorted(alone + [(a + len(line) + 1, k, b + len(line) + 1) for a, k, b in alone])


def test_media_round_trip(spark):
    texts = ["", None, "hello", "hello", "漢字 " * 100, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    rows = {r.n: r for r in media.store_telephony(df, "n").collect()}
    for i, t in enumerate(texts):
        name, back, _ = media.read_container(bytes(rows[i].media))
        assert name == rows[i].codec and back == media.padded(t) == bytes(rows[i].payload)
        assert rows[i].feature.startswith(name + ";samples=") and bytes(rows[i].pcm)[:4] == b"RIFF"
    assert rows[2].feature == rows[3].feature and bytes(rows[2].media) == bytes(rows[3].media) and rows[0].media == rows[1].media
    assert "n" in media.media_digests(media.store_telephony(df, "n"), "n").columns


def test_long_pieces_of_bpe(spark):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    whole = tiktoken.Encoding("whole", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(9)
    words = ["".join(rng.choice("aenrst") for _ in range(n)) for n in (1, 2, 3, 57, 256, 257, 1000)] + ["a" * 700, "é漢" * 300, "the" * 100, "x" * bpe.LONG]
    for word in [*words, "".join(rng.choice("etaoinshr") for _ in range(200_000)), "o" * 200_000]:
        assert bpe.merged(word.encode(), ranks) == whole.encode(word)
    table = spark.createDataFrame([(bytearray(w.encode()),) for w in words], "word binary")
    assert {bytes(r.word): r.ids for r in bpe.fold_pieces(table, ranks).collect()} == {w.encode(): whole.encode(w) for w in words}


def bpe_texts():
    rng = random.Random(11)
    marks = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'r", "'l", "''", "'", "s", "e", "re", "ll", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", *"\u1680\u2000\u200a\u2028\u202f\u205f\u3000\u180e\u200b", "a", "Z", "é", "漢字", "é́", "𝐀", "7", "12", "²", "Ⅻ", "𝟘", ".", ",", "-", "’s", "🙂", "\U0010ffff"]
    made = ["".join(rng.choice(marks) for _ in range(rng.randrange(30))) for _ in range(3000)]
    return [None, "", "it'", "s", "it'r", "e", " ", "'s", "a\u3000", "b", "a \xa0", " b", None, *marks, *made, "", None]


def test_pieces_are_the_matches_of_the_pattern(monkeypatch):
    texts, wanted = bpe_texts(), [bpe.split_pieces(t or "", P.PATTERN) for t in bpe_texts()]
    monkeypatch.setattr(bpe, "split_pieces", None)  # no match is made for each text
    whole = pa.array(texts, pa.string())
    for at, n in ((0, len(texts)), (1, 1), (2, 7), (5, 100), (len(texts) - 2, 2), (3, 0)):
        codes, counts, pieces, raw = bpe.pieces_of(whole.slice(at, n), P.PATTERN)
        flat = [p.decode() for p in pieces.take(pa.array(codes)).to_pylist()]
        assert flat == [p for own in wanted[at : at + n] for p in own]
        assert counts.tolist() == [len(own) for own in wanted[at : at + n]]
        assert len(set(pieces.to_pylist())) == len(pieces)
        assert raw.to_pylist() == [(t or "").encode() for t in texts[at : at + n]]


@pytest.mark.parametrize("pattern", [P.PATTERN, r"[\p{L}\p{N}]+|\s*[\r\n]+|\s+|[^\s\p{L}\p{N}]+"])
def test_bpe_of_odd_texts_and_of_patterns_that_join_blanks(spark, pattern):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = list(enumerate([*bpe_texts(), "one \n\n two\n \nthree\n\n\nfour"]))
    got = bpe.encode_bpe(documents(spark, rows), path, pattern).collect()
    assert {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in got} == {i: (own.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}
    empty = bpe.encode_bpe(documents(spark, [(1, None), (2, "")]), path, pattern).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in empty) == [(1, b"", b""), (2, b"", b"")]
