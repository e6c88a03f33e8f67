"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens of a whole document form one chain with the tags outside, begin and
inside.  A token's score is the sum of weights of its own shape, length,
characters and word, of the same features of its neighbours, and of
features of the file.  The field is trained here, by exact gradients of the
log-likelihood, on a bounded sample of documents whose tags come from the
patterns; weights are then rounded to integers.

Decoding is Viterbi's.  Positions that no stretch of begin and inside tags
with a positive gain can reach are outside on the best path (see
``_windows``), so the recursion runs over the remaining windows only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import boxed, prepare, unboxed

# --- Fixed values: kinds of base spans in their order, their patterns and least lengths ---
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
# --- end of fixed values ---
ADDED = "crf"
_HINTS = ("passw", "secret", "token", "api")

# Bounds of the training sample: documents looked at, documents used with and without a base span,
# and characters of each (longer ones are not used for training).
SAMPLE_DOCS, TRAIN_WITH, TRAIN_WITHOUT, TRAIN_MAX_CHARS = 20_000, 200, 200, 20_000
EPOCHS, RATE, RIDGE, CHAIN = 40, 0.2, 1e-5, 64
SCALE = 1024
BLOCK_CHARS = 1_000_000
CACHE = 200_000
O, B, I = 0, 1, 2
NEVER = -(10**7)

# Pieces cover a text up to blanks at its end: leading blanks, then a token (letters, digits and +/._- with closing =, or one other character).
PIECE = re.compile(r"\s*(?:[\w+/.\-]+=*|[^\w\s])")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the patterns' matches, by start and order of kinds."""
    found = []
    lower = text.lower()
    if any(h in lower for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    # a run shorter than the least length never matches, wherever it is entered
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str) -> list[tuple[int, int]]:
    """The parts of base spans that are the secret itself."""
    out = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    return out + [m.span() for p in (ACCESS, HEX) for m in p.finditer(text)]


_CLASS = str.maketrans(
    {**{c: "a" for c in "ghijklmnopqrstuvwxyz"}, **{c: "x" for c in "abcdef"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "123456789"}}
)
_SIZES = [1, 2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 40, 48, 64]
LONGEST = 64


def _before(blank: str) -> str:
    return "new" if "\n" in blank else "gap" if blank else "glued"


def outline(token: str, before: str) -> tuple:
    """What a token's features depend on, its word aside: few tokens have one of their own."""
    size = min(len(token), LONGEST)
    if token.isalpha():  # most tokens: their case says it all
        case = "a" if token.islower() else "Aa" if token.istitle() else "A" if token.isupper() else "aA"
        return before, size, case, case
    kinds = re.sub(r"[^\x00-\x7F]", "a", token.translate(_CLASS))
    used = set(kinds)
    charset = "h" if used == {"x", "0"} else ""
    charset += "".join(n for n, some in (("l", used & {"a", "x"}), ("U", "A" in used), ("d", "0" in used), ("s", used - set("axA0"))) if some)
    turns = re.sub(r"(.)\1+", r"\1", kinds.replace("x", "a"))
    return before, size, charset, turns[: 1 + size * 2 // 3]


def features(before: str, size: int, charset: str, turns: str) -> tuple[list[str], list[str]]:
    """Features of a token with that outline, and of the token as a neighbour."""
    step = sum(size >= s for s in _SIZES)
    mix = min(9, 10 * (len(turns) - 1) // max(1, size))
    own = [f"size {step}", f"set {charset}", f"size set {step} {charset}", f"mix {charset} {mix}", f"mix size {mix} {step}", f"turns {turns[:6]}", f"before {before}"]
    return own, [f"set {charset} {min(step, 6)}", f"before {before}"]


def word_of(token: str) -> str | None:
    """The word feature of a short token without digits."""
    if len(token) > 16 or (not token.isalpha() and any(c.isdigit() for c in token)):
        return None
    return "word " + (token.lower().strip("\"'-_=+/.") or token)


def describe(piece: str) -> tuple[list[str], list[str]]:
    """All features of a piece's own token, and of the piece as a neighbour."""
    token = piece.lstrip()
    own, near = features(*outline(token, _before(piece[: len(piece) - len(token)])))
    word = word_of(token)
    return (own + [word], near + [word]) if word else (own, near)


def _file_features(tokens: int, digits: int, assigns: int) -> list[str]:
    share = lambda n: min(6, int(n * 64 / max(1, tokens)).bit_length())
    return [f"tokens {min(14, tokens.bit_length())}", f"digits {share(digits)}", f"assigns {share(assigns)}"]


def _has_digit(piece: str) -> bool:
    return not piece.lstrip().isalpha() and any(c.isdigit() for c in piece)


def _is_assign(piece: str) -> bool:
    return piece.lstrip() in ("=", ":")


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


@dataclass
class Field:
    """Integer weights (begin and inside, relative to outside) by feature, and transitions relative to outside-outside."""

    own: dict[str, tuple[int, int]]
    left: dict[str, tuple[int, int]]  # features of the token before
    right: dict[str, tuple[int, int]]  # features of the token behind
    file: dict[str, tuple[int, int]]
    steps: list[list[int]]  # steps[from][to]


class _Bags:
    """Features of distinct pieces as index lists, for training."""

    def __init__(self, bags: list[list[str]], counts: np.ndarray, least: int):
        seen: dict[str, int] = {}
        for bag, n in zip(bags, counts):
            for f in bag:
                seen[f] = seen.get(f, 0) + int(n)
        self.names = sorted(f for f, n in seen.items() if n >= least)
        at = {f: k for k, f in enumerate(self.names)}
        pairs = [(i, at[f]) for i, bag in enumerate(bags) for f in bag if f in at]
        self.item, self.feature = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        self.n = len(bags)
        self.weights = np.zeros((len(self.names), 3))

    def scores(self) -> np.ndarray:
        return np.stack([np.bincount(self.item, self.weights[self.feature, t], self.n) for t in range(3)], axis=1)

    def gradient(self, by_item: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.feature, by_item[self.item, t], len(self.names)) for t in range(3)], axis=1)

    def rounded(self) -> dict[str, tuple[int, int]]:
        w = np.rint((self.weights[:, 1:] - self.weights[:, :1]) * SCALE).astype(int)
        return {f: (int(b), int(i)) for f, (b, i) in zip(self.names, w) if b or i}


def train(texts: list[str]) -> Field | None:
    """Fit a field to the patterns' tags in ``texts``; None if they hold no secret."""
    ids: dict[str, int] = {"": 0}  # 0 stands between documents
    tokens, tags, files, bags = [0], [O], [0], [[]]
    for text in texts:
        pieces = PIECE.findall(text)
        ends = np.cumsum([len(p) for p in pieces])
        tag = np.zeros(len(pieces), np.int64)
        for s, e in _values(text):
            inside = np.flatnonzero((ends > s) & (ends - [len(p.lstrip()) for p in pieces] < e))
            tag[inside] = I
            tag[inside[:1]] = B
        bags.append(_file_features(len(pieces), sum(map(_has_digit, pieces)), sum(map(_is_assign, pieces))))
        tokens += [ids.setdefault(p, len(ids)) for p in pieces] + [0]
        tags += tag.tolist() + [O]
        files += [len(bags) - 1] * (len(pieces) + 1)
    if not any(tags):
        return None
    pad = -len(tokens) % CHAIN
    tok, y, doc = (np.array(v + [0] * pad, dtype=np.int64) for v in (tokens, tags, files))
    pieces = list(ids)
    described = [describe(p) if p else (["edge"], ["edge"]) for p in pieces]
    # a second copy of all chains hides how long tokens are: other features must tell secrets of other lengths
    described += [([f for f in own if "size" not in f], near) for own, near in described]
    tok, y, doc = np.concatenate([tok, tok + len(pieces)]), np.tile(y, 2), np.tile(doc, 2)
    counts = np.bincount(tok, minlength=len(described))
    own = _Bags([d[0] for d in described], counts, 3)
    left, right = (_Bags([d[1] for d in described], counts, 3) for _ in range(2))
    file = _Bags(bags, np.bincount(doc, minlength=len(bags)), 1)
    before, behind = np.roll(tok, 1), np.roll(tok, -1)
    steps = np.zeros((3, 3))
    shape = (len(tok) // CHAIN, CHAIN)
    truth = np.eye(3)[y]
    pairs = np.zeros((3, 3))
    ys = y.reshape(shape)
    np.add.at(pairs, (ys[:, :-1].ravel(), ys[:, 1:].ravel()), 1.0)
    parts = [(own, tok), (left, before), (right, behind), (file, doc)]
    banned = np.zeros((3, 3))
    banned[O, I] = -1e4  # an inside tag follows begin or inside
    state = [[np.zeros_like(p.weights), np.zeros_like(p.weights)] for p, _ in parts] + [[np.zeros((3, 3)), np.zeros((3, 3))]]
    for epoch in range(1, EPOCHS + 1):
        e = sum(p.scores()[at] for p, at in parts).reshape(*shape, 3)
        t = steps + banned
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0]
        for k in range(1, CHAIN):
            alpha[:, k] = e[:, k] + _log_sum(alpha[:, k - 1, :, None] + t, 1)
        for k in range(CHAIN - 2, -1, -1):
            beta[:, k] = _log_sum(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        z = _log_sum(alpha[:, -1], 1)
        missed = truth - np.exp(alpha + beta - z[:, None, None]).reshape(-1, 3)
        both = alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
        up = [p.gradient(np.stack([np.bincount(at, missed[:, c], p.n) for c in range(3)], axis=1)) for p, at in parts]
        up.append(pairs - np.exp(both).sum(axis=(0, 1)))
        for k, g in enumerate(up):
            w = parts[k][0].weights if k < len(parts) else steps
            g = g - RIDGE * len(tok) * w
            m, v = state[k]  # Adam: running means of gradient and square
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    rel = np.rint((steps - steps[O, O]) * SCALE).astype(int)
    rel[O, I] = NEVER
    return Field(own.rounded(), left.rounded(), right.rounded(), file.rounded(), rel.tolist())


def _windows(gain: np.ndarray) -> np.ndarray:
    """Whether a position may lie in a stretch of positive total, given bounds of each position's gain.

    Of such a stretch, the part before or the part from a position on is
    positive, so a running sum that restarts at zero is positive at the
    position, or beside it, in one of the two directions.
    """
    total = np.concatenate([[0], np.cumsum(gain)])
    forward = total[1:] > np.minimum.accumulate(total)[:-1]
    backward = total[:-1] < np.maximum.accumulate(total[::-1])[::-1][1:]
    near = forward | backward
    wide = near.copy()
    wide[1:] |= near[:-1]
    wide[:-1] |= near[1:]
    return wide


def viterbi(begin: list[int], inside: list[int], steps: list[list[int]]) -> list[int]:
    """Best tags between two outside tags; scores are relative to outside, ties go to outside, then begin."""
    score, back = (0, NEVER, NEVER), []
    for b, i in zip(begin, inside):
        links = []
        new = []
        for tag, own in ((O, 0), (B, b), (I, i)):
            best = max(range(3), key=lambda s: (score[s] + steps[s][tag], -s))
            links.append(best)
            new.append(score[best] + steps[best][tag] + own)
        back.append(links)
        score = new
    tag = max(range(3), key=lambda s: (score[s] + steps[s][O], -s))
    tags = []
    for links in reversed(back):
        tags.append(tag)
        tag = links[tag]
    return tags[::-1]


class Tagger:
    """Scores of distinct pieces, kept while a task lasts (at most CACHE of them)."""

    def __init__(self, field: Field):
        self.field = field
        s = field.steps
        self.enter = (max(s[O][B], s[B][B], s[I][B]), max(s[B][I], s[I][I]))
        self.leave = max(0, s[B][O], s[I][O])
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 9), np.int64)
        self.outlines: dict[tuple, list[int]] = {}
        self.files: dict[tuple, tuple[int, int]] = {}
        self._add("", self._sums(["edge"], ["edge"]), 0, False, False)
        self.rows[0] = (NEVER, NEVER, *self.rows[0][2:])

    def _sums(self, own: list[str], near: list[str]) -> list[int]:
        f = self.field
        return [sum(w[x][k] for x in bag if x in w) for w, bag in ((f.own, own), (f.left, near), (f.right, near)) for k in (0, 1)]

    def _add(self, piece: str, sums: list[int], size: int, digit: bool, assign: bool) -> int:
        at = self.ids[piece] = len(self.rows)
        self.rows.append((*sums, size, digit, assign))
        return at

    def _id(self, piece: str) -> int:
        token = piece.lstrip()
        shape = outline(token, _before(piece[: len(piece) - len(token)]))
        sums = self.outlines.get(shape)
        if sums is None:
            sums = self.outlines[shape] = self._sums(*features(*shape))
        word, f = word_of(token), self.field
        if word and (word in f.own or word in f.left or word in f.right):
            sums = [a + b for a, b in zip(sums, self._sums([word], [word]))]
        return self._add(piece, sums, len(token), _has_digit(piece), _is_assign(piece))

    def _file(self, found: tuple) -> tuple[int, int]:
        if found not in self.files:
            known = [self.field.file.get(x, (0, 0)) for x in found]
            self.files[found] = sum(k[0] for k in known), sum(k[1] for k in known)
        return self.files[found]

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """``(start, end)`` of the decoded secrets of each text."""
        if len(self.ids) > CACHE:
            self._clear()
        tokens, lengths, sizes = [0], [0], []
        get, ids = self._id, self.ids
        for text in texts:
            pieces = PIECE.findall(text)
            tokens += [ids[p] if p in ids else get(p) for p in pieces]
            tokens.append(0)
            lengths += map(len, pieces)
            lengths.append(0)
            sizes.append(len(pieces) + 1)
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table) :], dtype=np.int64)])
        tok, table = np.array(tokens, dtype=np.int64), self.table
        ends = np.cumsum(sizes)
        starts = ends - sizes + 1  # first token of each text
        doc = np.repeat(np.arange(len(texts)), sizes)
        digits, assigns = (np.concatenate([[0], np.cumsum(table[tok, c])]) for c in (7, 8))
        file = np.array(
            [
                self._file(tuple(_file_features(int(e - s), int(digits[e] - digits[s]), int(assigns[e] - assigns[s]))))
                for s, e in zip(starts, ends)
            ],
            dtype=np.int64,
        ).reshape(len(texts), 2)
        score = []
        for k in (0, 1):
            own, left, right = table[:, k][tok], table[:, 2 + k][tok], table[:, 4 + k][tok]
            own[1:] += left[:-1] + file[doc, k]
            own[:-1] += right[1:]
            own[tok == 0] = NEVER
            score.append(own)
        marked = _windows(np.maximum(score[0] + self.enter[0], score[1] + self.enter[1]) + self.leave) & (tok != 0)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]])))
        at = np.cumsum(lengths)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            tags = viterbi(score[0][s:e].tolist(), score[1][s:e].tolist(), self.field.steps)
            k = int(doc[s - 1])
            base = int(at[starts[k] - 1])
            for i, tag in enumerate(tags, s):
                if tag:
                    span = (int(at[i] - table[tok[i], 6]) - base, int(at[i]) - base)
                    if tag == B:
                        out[k].append(span)
                    else:
                        out[k][-1] = (out[k][-1][0], span[1])
        return out


def _joined(base: list[tuple[int, int, str]], added: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """Base spans and those added ones that no base span holds already."""
    new = [(s, e, ADDED) for s, e in added if not any(a <= s and e <= b for a, b, _ in base)]
    return sorted(base + new, key=lambda x: (x[0], [*KINDS, ADDED].index(x[2])))


def _scanner(field: Field | None):
    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        tagger = Tagger(field) if field else None
        out, i = [], 0
        while i < len(values):
            j, size = i + 1, len(values[i])
            while j < len(values) and size + len(values[j]) <= BLOCK_CHARS:
                size += len(values[j])
                j += 1
            added = tagger.spans(values[i:j]) if tagger else [[]] * (j - i)
            for text, more in zip(values[i:j], added):
                out.append([{"kind": k, "start": s, "end": e} for s, e, k in _joined(base_spans(text), more)])
            i = j
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))

    return run


def training_texts(docs: DataFrame, text_col: str = "text") -> list[str]:
    """At most TRAIN_WITH texts with a base span and TRAIN_WITHOUT without, of about SAMPLE_DOCS documents chosen by a hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).filter(
        F.col("text").isNotNull() & (F.pmod("h", F.lit(1_000_003)) <= int(share * 1_000_003)) & (F.length("text") <= TRAIN_MAX_CHARS)
    )
    has = F.col("text").rlike("(?i)" + ASSIGN.pattern.replace(")+", "){8,}")) | F.col("text").rlike(ACCESS.pattern) | F.col("text").rlike(HEX.pattern)
    rows = rows.distinct().withColumn("has", has)
    picked = [
        rows.filter(F.col("has") if some else ~F.col("has")).orderBy("h", "text").limit(n).collect()
        for some, n in ((True, TRAIN_WITH), (False, TRAIN_WITHOUT))
    ]
    return [r["text"] for part in picked for r in part]


def scan(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Add ``secrets`` to each document: an array of (kind, start, end), code points, end exclusive.

    ``field`` is trained on ``docs`` (``training_texts``) unless one is given.

    Kinds ``assign``, ``access`` and ``hex`` are the patterns' matches,
    ``crf`` the spans that the field adds (those inside a pattern's match
    are left out).  Sorted by start, then in that order of kinds.

    Edge cases: null and empty texts have no spans; whole texts of any
    length are scanned (memory in proportion to one text); without a secret
    in the training sample nothing is added; equal texts get equal results
    and rows are never dropped; an empty table gives an empty table; extra
    columns stay, a clashing name gets underscores.
    """
    prepare(docs.sparkSession)
    field = field or train(training_texts(docs, text_col))
    done = _scanner(field).asNondeterministic()(F.col(f"`{text_col}`").cast("string"))
    return unboxed(boxed(docs, done=done), docs.columns, add={"secrets": F.col("done")})
