"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail addresses, IP addresses, card numbers and phone numbers.  The random field adds
spans that the patterns miss, such as phone numbers without a country code.  It is trained here from the
small labelled table below by gradient ascent, and decoded by Viterbi in numpy batches.  Lines with a digit or
an at sign are decoded whole; in any other line no span is plausible.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, byte_slices, texts_of

#: Kinds in the order of the contract.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, MARK = re.compile("[0-9]"), re.compile("[0-9@]")
WORD = re.compile(r"\S+")
#: Words whose class a worker remembers; words that are decoded together.
CACHE, WORDS = 100_000, 200_000
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))

#: The labelled table: [kind|text] marks a span; # stands for a digit that varies from copy to copy.
LABELLED = (
    "please call [phone|(###) ###-####] before noon",
    "call me at [phone|###-###-####] today",
    "phone [phone|+# (###) ###-####] or write",
    "tel [phone|+## ### ### ####] and ask",
    "my number is [phone|(###) ###-####] thanks",
    "the line. [phone|+# ### ### ####] is open",
    "fax [phone|###.###.####] at the office",
    "mail [email|ann@example.com] or bob",
    "write to [email|x.##@mail#.example.com] soon",
    "send it to [email|first.last@example.org] please",
    "contact [email|##@mail#.example.com] here",
    "server [ip|###.###.##.#] went down",
    "from [ip|##.#.###.##] the log says",
    "host [ip|#.##.##.###] of the net",
    "pay with card [card|#### #### #### ####] now",
    "card [card|################] was charged",
    "number [card|####-####-####-####] on file",
    "in #### there were ## of them",
    "the year #### and page ### of volume #",
    "version #.# was built in ####",
    "about ### people and #,### houses",
    "chapter ## on page ### has # lines",
    "token = \"#a##b#c###d#e##\" in the file",
    "key a#b##c#d##e#f### is set",
    "id ##a#bc#d and ref x## are internal",
    "score of #-# after ## minutes",
    "it was ##.# or ##% of the sum",
    "see @ the end of it and so on",
    "the cat sat on the mat and that was all",
    "on ####-##-## at ##:## it rained",
)
COPIES, STEPS, PENALTY = 4, 200, 0.02


def shape(word: str) -> str:
    """Runs of letters as x, of digits as d with their length up to 9, all else as it is."""
    out = re.sub("[^\\W\\d_]+", "x", word)
    return re.sub("[0-9]+", lambda m: f"d{min(len(m[0]), 9)}", out)


def loose(word: str) -> str:
    """Coarser: runs of letters and digits without lengths."""
    return re.sub("(.)\\1+", "\\1", re.sub("[0-9]+", "d", re.sub("[^\\W\\d_]+", "x", word)))


def word_class(word: str) -> tuple[str, ...]:
    """What a word's own features depend on: its shape, its looser shape and its digits, dots and at sign."""
    if word.isalpha():
        return ("x", "x", "0", "none", "False", "0", "False")
    soft, digits = loose(word), sum(c in "0123456789" for c in word)
    kind = "none" if not digits else "all" if digits == len(word) else "most" if 2 * digits > len(word) else "some"
    return shape(word), soft, str(min(digits, 12)), kind, str("@" in word), str(min(word.count("."), 4)), str(kind == "some" and "x" in soft and "@" not in word)


def class_features(own: tuple[str, ...], before: str, after: str) -> list[str]:
    """Features of a word of a class, between words of these looser shapes."""
    form, soft, digits, kind, at, dots, mix = own
    return ["1", f"s={form}", f"l={soft}", f"p={before}", f"n={after}", f"pl={before}|{soft}", f"ln={soft}|{after}", f"d={digits}", f"k={kind}", f"at={at}", f"dots={dots}", f"mix={mix}"]


def features(words: list[str]) -> list[list[str]]:
    classes = [word_class(w) for w in words]
    soft = ["^", *(c[1] for c in classes), "$"]
    return [class_features(c, soft[i], soft[i + 2]) for i, c in enumerate(classes)]


def labelled_table(copies: int = COPIES) -> list[tuple[list[str], list[str]]]:
    rows, state = [], 12345
    for line in LABELLED * copies:
        words, tags = [], []
        for piece in re.findall(r"\[[a-z]+\|[^\]]+\]|[^\[]+", line):
            kind, text = piece[1:-1].split("|", 1) if piece[0] == "[" else ("", piece)
            for j, w in enumerate(text.split()):
                drawn = ""
                for c in w:
                    if c == "#":
                        state = (state * 1103515245 + 12345) % (1 << 31)
                        c = str(state >> 16 & 7 or 9)
                    drawn += c
                words.append(drawn)
                tags.append(f"{'I' if j else 'B'}-{kind}" if kind else "O")
        rows.append((words, tags))
    return rows


@dataclass
class Field:
    """Weights: feature name to row of ``emit`` (feature x label), and transitions between labels."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, sentences: list[list[str]]) -> list[np.ndarray]:
        """Scores of all labels for each word; words of one class between equal looser shapes are scored once."""
        known, classes, rows, scored = {}, {}, {}, []
        where = []
        for words in sentences:
            own = []
            for w in words:
                if (c := known.get(w)) is None:
                    if len(known) > CACHE:
                        known.clear()
                    c = word_class(w)
                    c = known[w] = classes.setdefault(c, c)
                own.append(c)
            soft = ["^", *(c[1] for c in own), "$"]
            for i, c in enumerate(own):
                key = (c, soft[i], soft[i + 2])
                if (k := rows.get(key)) is None:
                    k = rows[key] = len(scored)
                    found = [self.names[f] for f in class_features(*key) if f in self.names]
                    scored.append(self.emit[found].sum(axis=0))
                where.append(k)
        flat = np.array(scored).reshape(-1, len(LABELS))[where]
        return np.split(flat, np.cumsum([len(w) for w in sentences])[:-1]) if sentences else []


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@lru_cache(maxsize=1)
def train(steps: int = STEPS, penalty: float = PENALTY) -> Field:
    """Maximise the penalised conditional likelihood of the labelled table by adaptive gradient ascent."""
    table = labelled_table()
    names: dict[str, int] = {}
    found = [[[names.setdefault(f, len(names)) for f in own] for own in features(words)] for words, _ in table]
    n, width, size = len(table), max(len(w) for w, _ in table), len(LABELS)
    index = np.zeros((n, width, len(found[0][0])), np.int64)
    gold, mask = np.zeros((n, width), np.int64), np.zeros((n, width), bool)
    for r, (words, tags) in enumerate(table):
        index[r, : len(words)] = found[r]
        gold[r, : len(words)] = [LABELS.index(t) for t in tags]
        mask[r, : len(words)] = True
    emit, move = np.zeros((len(names), size)), np.zeros((size, size))
    seen_e, seen_m = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    hot = np.eye(size)[gold] * mask[..., None]
    pairs = np.einsum("rti,rtj->ij", hot[:, :-1], hot[:, 1:])
    for _ in range(steps):
        score = emit[index].sum(axis=2) * mask[..., None]
        ahead, behind = np.zeros((n, width, size)), np.zeros((n, width, size))
        ahead[:, 0] = score[:, 0]
        for t in range(1, width):
            step = _logsum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = _logsum(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        total = _logsum(ahead[:, -1], 1)
        belief = np.exp(ahead + behind - total[:, None, None]) * mask[..., None]
        both = np.exp(ahead[:, :-1, :, None] + move + (score + behind)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        up_e, up_m = -penalty * emit, pairs - both.sum(axis=(0, 1)) - penalty * move
        np.add.at(up_e, index.ravel(), np.repeat((hot - belief).reshape(-1, size), index.shape[2], axis=0))
        seen_e += up_e**2
        seen_m += up_m**2
        emit += 0.3 * up_e / np.sqrt(seen_e)
        move += 0.3 * up_m / np.sqrt(seen_m)
    return Field(names, emit, move)


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of a batch, decoded side by side."""
    if not scores:
        return []
    n, width, size = len(scores), max(map(len, scores)), move.shape[0]
    lengths = np.array([len(s) for s in scores])
    block = np.zeros((n, width, size))
    for i, s in enumerate(scores):
        block[i, : len(s)] = s
    best, back = block[:, 0].copy(), np.zeros((n, width, size), np.int64)
    for t in range(1, width):
        ways = best[:, :, None] + move
        came, live = ways.argmax(axis=1), lengths > t
        back[:, t] = np.where(live[:, None], came, np.arange(size))
        best = np.where(live[:, None], np.take_along_axis(ways, came[:, None, :], 1)[:, 0] + block[:, t], best)
    out, label = np.zeros((n, width), np.int64), best.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        out[:, t] = label
        label = back[np.arange(n), t, label]
    return [out[i, :k] for i, k in enumerate(lengths)]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that hold, in order."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, 0, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def lines_of(text: str) -> list[list[tuple[int, int]]]:
    """The words of each line that has a digit or an at sign, as character intervals."""
    out, end = [], -1
    for mark in MARK.finditer(text):
        if mark.start() > end:
            start = text.rfind("\n", 0, mark.start()) + 1
            end = text.find("\n", mark.start())
            end = len(text) if end < 0 else end
            out.append([m.span() for m in WORD.finditer(text, start, end)])
    return out


def plausible(kind: int, text: str) -> bool:
    """What the field adds must look like its kind at least."""
    digits = sum(c in "0123456789" for c in text)
    if kind == 0:
        return "@" in text and "." in text
    if re.search("[^\\W\\d_]", text):
        return False
    return {1: 4 <= digits <= 12 and text.count(".") == 3, 2: 12 <= digits <= 19, 3: 7 <= digits <= 15}[kind]


def added_spans(texts: list[str], base: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of the random field that touch no span of the patterns."""
    owner, where = [], []
    for i, text in enumerate(texts):
        if DIGIT.search(text) or "@" in text:
            for run in lines_of(text):
                owner.append(i)
                where.append(run)
    # lines of like length are decoded side by side, some thousands of words at once
    order = sorted(range(len(where)), key=lambda k: len(where[k]))
    owner, where = [owner[k] for k in order], [where[k] for k in order]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    hi = 0
    while (lo := hi) < len(where):
        hi = lo + 1
        while hi < len(where) and (hi - lo + 1) * len(where[hi]) <= WORDS:
            hi += 1
        part = where[lo:hi]
        labels = viterbi(field.scores([[texts[i][a:b] for a, b in run] for i, run in zip(owner[lo:], part, strict=False)]), field.move)
        for i, run, own in zip(owner[lo:], part, labels, strict=False):
            j = 0
            while j < len(run):
                name = LABELS[own[j]]
                if name[0] != "B":
                    j += 1
                    continue
                kind, k = KINDS.index(name[2:]), j + 1
                while k < len(run) and LABELS[own[k]] == f"I-{KINDS[kind]}":
                    k += 1
                start, end = run[j][0], run[k - 1][1]
                while end > start and texts[i][end - 1] in ".,;:!?\"'*&%$#":
                    end -= 1
                while start < end and texts[i][start] in "\"'*&%$#":
                    start += 1
                if plausible(kind, texts[i][start:end]) and not any(a < end and start < b for a, _, b in base[i]):
                    out[i].append((start, kind, end))
                j = k
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, base, added): arrays of ``kind:start:end`` in code points, end exclusive, in order of start.

    Null and empty texts have none.
    """
    kind = df.schema[id_col].dataType.simpleString()
    field = field or train()

    def run(batches):
        show = lambda spans: [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
        for part in byte_slices(batches):
            schema = pa.schema([part.schema.field(0), ("base", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])
            texts = texts_of(part)
            base = [base_spans(t) for t in texts]
            added = added_spans(texts, base, field)
            yield batch_of(schema, [part.column(0), list(map(show, base)), [show(sorted(set(x))) for x in added]])

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, base array<string>, added array<string>")


def masked(df: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``df`` with every found span of ``text_col`` replaced by its kind in angle brackets; nulls stay."""
    field = field or train()
    names, at = df.columns, df.columns.index(text_col)

    def run(batches):
        for part in byte_slices(batches, column=at):
            raw = part.column(at).to_pylist()
            texts = [t or "" for t in raw]
            base = [base_spans(t) for t in texts]
            out = []
            for text, old, own, more in zip(texts, raw, base, added_spans(texts, base, field), strict=True):
                done, pieces = 0, []
                for a, k, b in sorted([*own, *more]):
                    if b > done:
                        pieces.append(text[done:a] if a > done else "")
                        pieces.append(f"<{KINDS[k]}>" if a >= done else "")
                        done = b
                out.append(None if old is None else "".join(pieces) + text[done:])
            columns = list(part.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, df.schema)
