"""Personal data by patterns, completed by a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers. What they find are tokens
with a known label; between them stand open tokens: words with an at sign and groups of digits.
A word with neither can hold none of the four kinds and is left out as a certain "other".

Neighbouring tokens share a potential as in a linear chain. Tokens of one document that repeat (same
digits, same address) or are similar (same last seven digits, same name before the at sign) share one too,
however far apart, through a node of their group, so that a group of any size has as many edges as members.
Loopy message passing over both kinds of edges gives each open token its probabilities; one
whose most likely label is a kind, at more than one half, adds a span. So a number written without its plus sign
is found where the document has it in full elsewhere, and the same digits alone are not.

Weights are trained on a bounded sample by pseudo-likelihood: the patterns' finds, each mentioned again in
a shortened form that no pattern finds (to be labelled as it), open tokens as they are and made-up numbers of the same shapes (other).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokentally.llm.common import map_arrow

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
LABELS = OTHER + 1
# Texts that weights are trained on: the first in the order of a hash, of at most so many characters.
SAMPLE, SAMPLE_CHARS = 1000, 8192
# Characters between two tokens that still are neighbours in the chain.
NEAR = 40
ROUNDS = 8

# Each of these always takes a whole run of characters, so a search over a text is linear.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OPEN = re.compile(r"\+?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)*+")
_EDGES = "\"'()[]{}<>,;:!?.-"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        total += value if place % 2 == 0 else value * 2 - 9 * (value > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the patterns find, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, *m.span()) for m in _EMAIL.finditer(text) if m.group(1)]
    for m in _DOTTED.finditer(text) if "." in text else ():
        if m.group().count(".") >= 3:
            runs = [r.span() for r in _RUN.finditer(text, *m.span())]
            fours = [runs[i : i + 4] for i in range(0, len(runs) - 3, 4)]
            found += [(1, four[0][0], four[3][1]) for four in fours if all(_small(text[a:b]) for a, b in four)]
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(_digits(m.group())) <= 15:
            found.append((3, *m.span()))
    return found


@dataclass
class Token:
    start: int
    end: int
    text: str
    label: int  # a kind, or -1 for an open token

    def keys(self) -> tuple[str | None, str | None]:
        """What tokens of one document have in common that repeat, and that are similar."""
        if "@" in self.text:
            low = self.text.strip(_EDGES).lower()
            name = low.split("@")[0]
            return low, name + "@" if name else None
        digits = _digits(self.text)
        return digits if len(digits) >= 4 else None, "~" + digits[-7:] if len(digits) >= 7 else None


def tokens_of(text: str, spans: list[tuple[int, int, int]]) -> list[Token]:
    """Found spans (of several that overlap, the first by kind) and the open tokens between them, in order."""
    taken: list[tuple[int, int, int]] = []
    for kind in range(OTHER):
        starts = [a for a, _, _ in taken]
        new = []
        for _, a, b in [s for s in spans if s[0] == kind]:
            at = bisect_right(starts, a)
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                new.append((a, b, kind))
        taken = sorted(taken + new)
    out = [Token(a, b, text[a:b], kind) for a, b, kind in taken]
    place = 0
    for a, b in [*sorted((a, b) for _, a, b in spans), (len(text), len(text))]:
        out += _open_tokens(text, place, a)
        place = max(place, b)
    return sorted(out, key=lambda t: t.start)


def _open_tokens(text: str, start: int, end: int) -> list[Token]:
    if start >= end:
        return []
    out, words = [], []
    if text.find("@", start, end) >= 0:
        words = [m.span() for m in _WORD.finditer(text, start, end) if "@" in m.group()]
    place = start
    for a, b in [*words, (end, end)]:
        out += [Token(*m.span(), m.group(), -1) for m in _OPEN.finditer(text, place, a)]
        if a < b:
            core = text[a:b].strip(_EDGES)
            if len(core) > 1:
                first = text.index(core, a)
                out.append(Token(first, first + len(core), core, -1))
        place = b
    return out


FEATURES = 16


def features(text: str) -> list[float]:
    """What a token looks like by itself."""
    at = "@" in text
    digits = "" if at else _digits(text)
    n = len(digits)
    sizes = [not at and low <= n <= high for low, high in ((0, 3), (4, 6), (7, 8), (9, 12), (13, 19), (20, 1 << 60))]
    shape = [at, at and "." in text.split("@", 1)[1], text.startswith("+"), "(" in text, text.count(".") == 3, text.count(".") in (1, 2), "-" in text, " " in text, 13 <= n <= 19 and luhn(digits)]
    return [1.0, *map(float, sizes), *map(float, shape)]


# ---------------------------------------------------------------- the field

@dataclass
class Field:
    """Weights: label scores of features, of neighbours' labels, and of agreeing with repeated and similar tokens."""

    unary: np.ndarray
    chain: np.ndarray
    same: float
    similar: float


def prior() -> Field:
    """Without anything to learn from, every open token is other."""
    unary = np.zeros((FEATURES, LABELS))
    unary[0, OTHER] = 5.0
    return Field(unary, np.zeros((LABELS, LABELS)), 0.0, 0.0)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


def hub_weight(agreement: float) -> float:
    """The weight of two edges over a shared node that together reward agreement as one edge does."""
    reward = np.exp(agreement)
    return float(np.log(reward + np.sqrt(max(reward * reward + (LABELS - 2) * reward - (LABELS - 1), 0.0))))


def marginals(unary: np.ndarray, left: np.ndarray, right: np.ndarray, chain: np.ndarray, hubs: list[tuple[np.ndarray, np.ndarray, float]], known: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the labels of all tokens, by rounds of messages.

    ``left`` and ``right`` are the tokens of chain edges. A hub is (token, group, weight): its members and their groups. Open
    members look alike, so each counts its own looks only; they tell their group what reached them over other edges, together
    as one observation. Many equal unsure tokens thus do not outvote a known one.
    """
    n = len(unary)
    forward, backward = np.zeros((len(left), LABELS)), np.zeros((len(left), LABELS))
    to_hub = [np.zeros((len(t), LABELS)) for t, _, _ in hubs]
    from_hub = [np.zeros((len(t), LABELS)) for t, _, _ in hubs]
    share = []
    for token, group, _ in hubs:
        open_members = np.bincount(group, ~known[token], group.max() + 1 if len(group) else 0)
        share.append(np.where(known[token], 1.0, 1.0 / np.maximum(open_members[group], 1))[:, None])
    belief = unary
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, right, forward)
        np.add.at(belief, left, backward)
        for (token, _, _), message in zip(hubs, from_hub):
            np.add.at(belief, token, message)
        new = _normal(_through(belief[left] - backward, chain))
        backward = _normal(_through(belief[right] - forward, chain.T))
        forward = new
        for k, (token, group, weight) in enumerate(hubs):
            if not len(token):
                continue
            agree = np.eye(LABELS) * weight
            told = belief[token] - from_hub[k] - np.where(known[token, None], 0.0, unary[token])
            to_hub[k] = _normal(_through(told, agree)) * share[k]
            total = np.zeros((group.max() + 1, LABELS))
            np.add.at(total, group, to_hub[k])
            from_hub[k] = _normal(_through(total[group] - to_hub[k], agree))
    belief = unary.copy()
    np.add.at(belief, right, forward)
    np.add.at(belief, left, backward)
    for (token, _, _), message in zip(hubs, from_hub):
        np.add.at(belief, token, message)
    return _normal(belief)[:n]


def _through(message: np.ndarray, potential: np.ndarray) -> np.ndarray:
    """Sum over the sender's label of its message and the edge's potential."""
    both = message[:, :, None] + potential[None]
    top = both.max(1, keepdims=True)
    return (top + np.log(np.exp(both - top).sum(1, keepdims=True)))[:, 0]


def graph(documents: list[list[Token]]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Chain edges (left, right) and the groups (token, group) of repeated and of similar tokens, of all documents."""
    left, hubs, place = [], [({}, [], []), ({}, [], [])], 0
    for number, tokens in enumerate(documents):
        for i, token in enumerate(tokens):
            if i and token.start - tokens[i - 1].end <= NEAR:
                left.append(place + i - 1)
            for (groups, members, of), key in zip(hubs, token.keys()):
                if key is not None:
                    members.append(place + i)
                    of.append(groups.setdefault((number, key), len(groups)))
        place += len(tokens)
    left = np.array(left, np.int64)
    return left, left + 1, [(np.array(m, np.int64), np.array(g, np.int64)) for _, m, g in hubs]


def added_spans(documents: list[list[Token]], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) that the field adds to each document."""
    tokens = [t for d in documents for t in d]
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    known = np.array([t.label >= 0 for t in tokens], bool)
    if not (~known).any():
        return out
    unary = np.array([features(t.text) for t in tokens]) @ field.unary
    unary[known] = -60.0
    unary[known, np.array([t.label for t in tokens])[known]] = 0.0
    left, right, groups = graph(documents)
    hubs = [(t, g, hub_weight(w)) for (t, g), w in zip(groups, (field.same, field.similar))]
    log = marginals(unary, left, right, field.chain, hubs, known)
    label = log.argmax(1)
    sure = ~known & (label != OTHER) & (log.max(1) > np.log(0.5))
    of = np.repeat(np.arange(len(documents)), [len(d) for d in documents])
    for i in np.flatnonzero(sure).tolist():
        out[of[i]].append((int(label[i]), tokens[i].start, tokens[i].end))
    return out


# ---------------------------------------------------------------- training

def _shortened(kind: int, text: str, way: int) -> str:
    """A further mention of a find in a form that no pattern finds."""
    digits = _digits(text)
    if kind == 0:
        name, host = text.split("@", 1)
        return f"{name}@" + host.split(".")[0]
    if kind == 1:
        return text.replace(".", "-")
    if kind == 2:
        return [f"{digits[:4]}.{digits[4:]}", f"{way % 90 + 10} {digits}", "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4))][way % 3]
    return [digits, f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-7:-4]}-{digits[-4:]}"][way % 3]


def _examples(texts: list[str]) -> tuple[list[list[Token]], list[list[int]]]:
    """Documents of tokens with their true labels; further mentions and made-up numbers come after a document's end."""
    rng = np.random.default_rng(7)
    documents, truth = [], []
    for text in texts:
        tokens = tokens_of(text, base_spans(text))
        labels = [t.label if t.label >= 0 else OTHER for t in tokens]
        place = len(text) + 1
        for t in [t for t in tokens if t.label >= 0]:
            mention = _shortened(t.label, t.text, int(rng.integers(1 << 16)))
            others = ["".join(str(rng.integers(10)) if c.isdigit() else "abcdefghij"[rng.integers(10)] if c.isalpha() else c for c in form) for form in (mention, mention, t.text)]
            for word, label in ((mention, t.label), *[(other, OTHER) for other in others]):
                if not base_spans(word):
                    tokens.append(Token(place, place + len(word), word, -1))
                    labels.append(label)
                    place += len(word) + int(rng.integers(1, 2 * NEAR))
        documents.append(tokens)
        truth.append(labels)
    return documents, truth


def train(texts: list[str], steps: int = 600, rate: float = 0.05, decay: float = 1e-5) -> Field:
    """Weights by gradient descent on the pseudo-likelihood of open tokens, given the labels of all they are linked to."""
    documents, truth = _examples(texts)
    tokens = [t for d in documents for t in d]
    labels = np.array([y for ys in truth for y in ys], np.int64)
    is_open = np.array([t.label < 0 for t in tokens], bool)
    if not len(labels) or (labels == OTHER).all():
        return prior()
    left, right, groups = graph(documents)
    eye = np.eye(LABELS)
    before, after = np.zeros((len(tokens), LABELS)), np.zeros((len(tokens), LABELS))
    before[right], after[left] = eye[labels[left]], eye[labels[right]]
    shared = []
    for token, group in groups:
        # The share of each label among the known members of a token's groups.
        known = ~is_open[token]
        total = np.zeros((group.max() + 1 if len(group) else 0, LABELS))
        np.add.at(total, group[known], eye[labels[token[known]]])
        told = np.zeros((len(tokens), LABELS))
        told[token] = total[group] / np.maximum(total[group].sum(1, keepdims=True), 1)
        shared.append(told[is_open])
    x = np.array([features(t.text) for t in tokens])[is_open]
    before, after, y = before[is_open], after[is_open], eye[labels[is_open]]
    # A label's examples weigh as much as its number's root.
    weight = 1 / np.sqrt(np.maximum(y.sum(0), 1))[y.argmax(1)]
    weight /= weight.sum()
    cuts = np.cumsum([FEATURES * LABELS, LABELS * LABELS, 1])
    weights, speed, spread = np.zeros(cuts[-1] + 1), np.zeros(cuts[-1] + 1), np.zeros(cuts[-1] + 1)
    for step in range(1, steps + 1):
        unary, chain, same, similar = np.split(weights, cuts)
        unary, chain = unary.reshape(FEATURES, LABELS), chain.reshape(LABELS, LABELS)
        score = x @ unary + before @ chain + after @ chain.T + same * shared[0] + similar * shared[1]
        error = (y - np.exp(_normal(score))) * weight[:, None]
        slope = [(x.T @ error).ravel(), (before.T @ error + error.T @ after).ravel(), [(error * shared[0]).sum()], [(error * shared[1]).sum()]]
        gradient = np.concatenate(slope) - decay * weights
        # Steps by running averages of the gradient and of its square.
        speed += 0.1 * (gradient - speed)
        spread += 0.01 * (gradient * gradient - spread)
        weights = weights + rate * (speed / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-9)
        weights[cuts[-2] :] = np.maximum(weights[cuts[-2] :], 0.0)
    unary, chain, same, similar = np.split(weights, cuts)
    return Field(unary.reshape(FEATURES, LABELS), chain.reshape(LABELS, LABELS), float(same[0]), float(similar[0]))


def fit(documents: DataFrame, text_column: str = "text", sample: int = SAMPLE, most: int = SAMPLE_CHARS) -> Field:
    """Weights from at most ``sample`` texts of at most ``most`` characters that may hold personal data.

    The texts are the first in the order of a hash of the text, so that equal tables give equal weights. Other texts are
    searched in full all the same; the bound is on training alone.
    """
    text = F.col(text_column).cast("string")
    # Java matches these at a given place in a bounded number of steps.
    likely = text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]|\+[0-9][ 0-9(]|[0-9]{4}[ -]?[0-9]{4}|[0-9]\.[0-9]{1,3}\.[0-9]")
    hashed = documents.select(text.alias("text")).where((F.length("text") <= most) & likely).withColumn("h", F.xxhash64("text"))
    # Hashes alone are ordered; the few texts are fetched by them.
    chosen = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    texts = hashed.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text"))
    return train([r.text for r in sorted(texts.collect())])


# ---------------------------------------------------------------- on tables

def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(documents: DataFrame, field: Field, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (what the patterns find) and spans (that and what the field adds), for every row.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind in the order of the counts, then start, joined by commas; counts
    are those of ``base``. A null or empty text has none. Rows with a null id and rows that repeat have results of their own. Other
    columns are ignored. Texts are searched whole; tokens are linked within one row only.
    """
    source = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        column = pc.fill_null(batch.column(1), "")
        rows = np.flatnonzero(pc.match_substring_regex(column, "[0-9@]").to_numpy(zero_copy_only=False))
        counts = np.zeros((batch.num_rows, OTHER), np.int64)
        base, whole = [""] * batch.num_rows, [""] * batch.num_rows
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            texts = column.take(pa.array(part)).to_pylist()
            found = [base_spans(t) for t in texts]
            # Without a find there is no known label to share, but the field judges all the same.
            more = added_spans([tokens_of(t, s) for t, s in zip(texts, found)], field)
            for row, spans, new in zip(part.tolist(), found, more):
                base[row], whole[row] = _told(spans), _told(spans + new)
                counts[row] = np.bincount([k for k, _, _ in spans], minlength=OTHER)
        yield {"doc_id": batch.column(0), **{f"n_{k}": counts[:, i] for i, k in enumerate(KINDS)}, "base": base, "spans": whole}

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


