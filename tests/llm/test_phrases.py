"""Collocations against counts of all phrases in a dictionary."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from flowmill.llm import phrases

KIND = "doc_id long, text string, lang string, source string, a long, key long"


def expected(rows, least, top, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        kept = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in kept.items():
            longer = any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items())
            score, _, left, right = min((1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            if not longer:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed):
    rng, words = random.Random(seed), ["New", "york", "city", "the", "a", "über", "x\x1cy", "é", "of", " ", "big"]
    rows = []
    for i in range(400):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\x0b"]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), "web", 1, 2))
    rows += [(1000 + i, "exact copy of a long piece without any mark " * 3, "en", "web", 1, 2) for i in range(150)]
    rows += [(2000, None, "en", "web", 1, 2), (2001, "", None, "web", 1, 2), (2002, "a a a a a a a a a a " * 300, "de", "web", 1, 2), (2003, "junk word " + "w" * 50_000, "fr", "web", 1, 2)]
    return rows


def test_collocations_equal_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET", 2000)  # several buckets
    for seed, top in ((1, 2000), (2, 7)):
        rows = texts(seed)
        table = spark.createDataFrame(rows, KIND).repartition(6)
        found = phrases.collocations(table, least=20, top=top)
        assert sorted(tuple(r) for r in found.collect()) == expected(rows, 20, top)


def test_no_documents_and_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], KIND)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "one two", "en", "web", 1, 2)], KIND)).collect() == []


def test_scores_pass_64_bits(spark):
    wide = spark.createDataFrame([(10**14, 4 * 10**15, 3 * 10**14, 2 * 10**14)], "a long, n long, l long, r long")
    assert wide.selectExpr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(19, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0))) AS s").first().s == 1000 * 10**14 * 4 * 10**15 // (3 * 10**14 * 2 * 10**14)


def test_bitmap_marks_what_it_holds(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 1000)
    bits = phrases.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert phrases.marked(bits, keys.view(np.uint64)).all()
    assert phrases.marked(bits, np.arange(100_000, dtype=np.uint64)).sum() < 10
