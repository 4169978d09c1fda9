r"""Personal data: exact base patterns, and a skip-chain conditional random field for what they miss.

The field's variables are the tokens (runs without white space) that hold a digit, '@' or a leading
'+', and tokens beside an '@' at a token's end; all other tokens are outside. Neighbouring variables
share a chain potential; tokens that repeat earlier ones, wholly, in their digits, in their last digits
or in the name before an '@', share a skip potential with the next such token, however far. Loopy
sum-product messages over both kinds of edges carry evidence across a document; tokens of base spans
are fixed to their kind, so a number or name that is certain in one place is found in others.

Potentials are trained piecewise on a bounded sample of documents: the token part by multinomial
regression, the edge parts each on its two ends.  Labels come from the base patterns, and from
variants of the spans they find that are written into the sampled texts at other places: spaced or cut
addresses, numbers with other marks, without their '+' or their area, with a mistyped digit. Tokens
that only resemble a kind (a long number whose checksum fails, an '@' without a domain) or repeat a
token of a span teach nothing, so the field, not the pattern, decides them.

Base spans always stay. The field adds runs of tokens of one label; a run ends where a base span begins.

Defined cases: a null or empty text has no spans; without any token to learn from only base spans are
found; rows that repeat a key are each searched; texts and tokens of any length are read whole; an empty
table gives no rows; other columns are not read by ``find`` and are kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sliced, texts

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is outside; label k + 1 is kind k.
N_LABELS = len(KINDS) + 1
#: At most this many documents, and a run of this many variables of each, are learned from.
SAMPLE_DOCUMENTS, SAMPLE_TOKENS = 600, 400
#: Hash buckets of token features; features of a token.
BUCKETS, N_FEATURES = 1 << 12, 10
#: Message rounds, damping, and the marginal from which a token counts.
ROUNDS, DAMPING, CERTAIN = 12, 0.3, 0.9
#: Edges, or tokens, whose scores are held at once.
EDGE_BLOCK = 50_000
#: How far the other labels of a token of a base span lie below its own, as log potentials.
GIVEN = 30.0
_EDGE = ".,;:!?|$%&*#\"'[]{}<>"

_word = re.compile(r"[^\x20\x09-\x0D]+")
_told = re.compile(r"[0-9@]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+){0,3}")
_digits = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_plus = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_not_digit = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _domain.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _dotted.finditer(text):
        parts = m[0].split(".")
        if len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _digits.finditer(text):
        digits = _not_digit.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _plus.finditer(text):
            if 9 <= len(_not_digit.sub("", m[0])) <= 15:
                yield m.span()


def base_spans(text: str) -> list[Span]:
    """The base spans as (start, kind, end), in order."""
    if not _told.search(text):
        return []
    return sorted((s, k, e) for k, find in enumerate((_emails, _ips, _cards, _phones)) for s, e in find(text))


@dataclass
class Tokens:
    """Variable tokens of many documents: place, features, and the edges between them."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _shape(token: str) -> str:
    """The token's classes with runs shortened."""
    out: list[str] = []
    for c in token:
        k = "0" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out)


def _features(token: str, before: str, after: str) -> list[int]:
    digits = len(_not_digit.sub("", token))
    named = (
        f"shape {_shape(token)}", f"digits {min(digits, 20)}", f"length {min(len(token), 24)}", f"head {token[:1] if not token[:1].isalnum() else _shape(token[:1])}",
        f"at {'@' in token} dots {min(token.count('.'), 4)}", f"before {_shape(before)}", f"after {_shape(after)}", f"word before {before.lower()}",
        f"marks {''.join(sorted(set(token) & set('+().-@')))}", "any",
    )
    return [zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in named]


def _keys(token: str) -> list[str]:
    """What a later token can repeat of this one."""
    core = token.strip(_EDGE + "()").lower()
    digits = _not_digit.sub("", core)
    keys = {core} if len(core) >= 4 else set()
    if len(digits) >= 7:
        keys |= {"#" + digits, "#" + digits[-7:]}
    if "@" in core and len(name := core.split("@")[0]) >= 4:
        keys.add(name)
    return sorted(keys)


def _variables(text: str) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(number, start, end, word, word before, word after) of the words that are variables."""
    none = (0, 0, "")
    back, now, number = none, none, -1
    for m in itertools.chain(_word.finditer(text), [None]):
        ahead = (m.start(), m.end(), m[0]) if m else none
        word = now[2]
        if word and (word[0] == "+" or _told.search(word) or ahead[2][:1] == "@" or back[2][-1:] == "@"):
            yield number, now[0], now[1], word, back[2], ahead[2]
        back, now, number = now, ahead, number + 1


def tokens_of(some: list[str]) -> Tokens:
    """The variables of the texts and their edges; only texts that hold a digit or '@' have any."""
    doc, start, end, beside, key, of_key = (array("q") for _ in range(6))
    features = array("i")
    for d, text in enumerate(some):
        if not _told.search(text):
            continue
        previous = -2
        for i, s, e, token, before, after in _variables(text):
            node = len(doc)
            doc.append(d)
            start.append(s)
            end.append(e)
            beside.append(previous == i - 1)
            features.extend(_features(token, before, after))
            previous = i
            for k in _keys(token):
                key.append(hash(k))
                of_key.append(node)
    doc, start, end, beside, key, of_key = (np.array(x, np.int64) for x in (doc, start, end, beside, key, of_key))
    chained = np.flatnonzero(beside)
    order = np.lexsort((of_key, doc[of_key], key))  # tokens of one key of a document stand together, in order
    key, of_key = key[order], of_key[order]
    a, b = of_key[:-1], of_key[1:]
    repeats = (key[1:] == key[:-1]) & (doc[a] == doc[b]) & (a < b) & ~((b == a + 1) & (beside[b] == 1))
    skip = np.unique(a[repeats] * (len(doc) + 1) + b[repeats])
    pairs = np.stack([skip // (len(doc) + 1), skip % (len(doc) + 1)], 1)
    return Tokens(doc, start, end, np.array(features, np.int32).reshape(-1, N_FEATURES), np.stack([chained - 1, chained], 1), pairs)


def _marked(tokens: Tokens, spans: list[list[Span]]) -> np.ndarray:
    """Labels of the tokens by the spans that they touch, 0 for others."""
    labels = np.zeros(len(tokens.doc), np.int64)
    first = np.searchsorted(tokens.doc, np.arange(len(spans) + 1))
    for d, of in enumerate(spans):
        own = slice(first[d], first[d + 1])
        for s, k, e in of:  # starts and ends ascend
            labels[own][np.searchsorted(tokens.end[own], s, side="right") : np.searchsorted(tokens.start[own], e)] = k + 1
    return labels


def variants(kind: int, span: str, draw: random.Random) -> str:
    """The span in a form that the base patterns do not take, or take in part."""
    digits = _not_digit.sub("", span)
    if kind == 0:
        name, domain = span.split("@", 1)
        return draw.choice([f"{name} @ {domain}", f"{name} @{domain}", f"{name}@ {domain}", f"{name}@{domain.split('.')[0]}"])
    if kind == 1:
        return draw.choice([",", "-", ":", " . "]).join(span.split("."))
    if kind == 2:
        at = draw.randrange(len(digits))
        typo = digits[:at] + str((int(digits[at]) + 1 + draw.randrange(8)) % 10) + digits[at + 1 :]
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return draw.choice([typo, typo, ".".join(fours), "/".join(fours), "_".join(fours)])
    last, area = f"{digits[-7:-4]}-{digits[-4:]}", digits[-10:-7]
    return draw.choice([f"{digits[:-10]} ({area}) {last}", f"({area}) {last}", f"{area}-{last}", f"{area}.{last}", last])


_dubious = re.compile(r"@|^\+|^[0-9](?:[ ._/-]?[0-9]){11,18}$|^[0-9]+(?:\.[0-9]+){3}$")


def example(text: str, draw: random.Random) -> tuple[Tokens, np.ndarray]:
    """Tokens of the text with a variant of each of its base spans written in elsewhere, and their labels.

    Label -1 teaches nothing: what only resembles a kind, or repeats what a span covers.
    """
    gaps = [m.end() for m in _word.finditer(text)]
    base = base_spans(text)
    free = [g for g in gaps if not any(s <= g < e for s, _, e in base)] or [len(text)]
    new = sorted((draw.choice(free), k, variants(k, text[s:e], draw)) for s, k, e in base)
    out, spans, at, shift = [], [], 0, 0
    moved = iter(sorted(base))
    ahead = next(moved, None)
    for place, k, form in [*new, (len(text) + 1, 0, "")]:
        while ahead is not None and ahead[0] < place:
            spans.append((ahead[0] + shift, ahead[1], ahead[2] + shift))
            ahead = next(moved, None)
        if place <= len(text):
            out += [text[at:place], f" {form} "]
            spans.append((place + shift + 1, k, place + shift + 1 + len(form)))
            at, shift = place, shift + len(form) + 2
    out.append(text[at:])
    whole = "".join(out)
    tokens = tokens_of([whole])
    labels = _marked(tokens, [sorted(spans)])
    told = {x for a, b in tokens.skip.tolist() if labels[a] or labels[b] for x in (a, b)}
    for i in np.flatnonzero(labels == 0).tolist():
        if i in told or _dubious.search(whole[tokens.start[i] : tokens.end[i]].strip(_EDGE)):
            labels[i] = -1
    return tokens, labels


def _some(tokens: Tokens, labels: np.ndarray, start: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(labels, features, chain, skip) of a run of variables; edges that leave it are left out."""
    edges = [p[((p >= start) & (p < start + n)).all(1)] - start for p in (tokens.chain, tokens.skip)]
    return labels[start : start + n], tokens.features[start : start + n], *edges


@dataclass
class Field:
    """Log potentials: of features by label, of chain edges, of skip edges."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def _token_weights(x: np.ndarray, y: np.ndarray, rounds: int) -> np.ndarray:
    """Multinomial regression of labels on hashed features, by Adam over all of them."""
    w, m, v = (np.zeros((BUCKETS, N_LABELS)) for _ in range(3))
    flat, truth = x.ravel(), np.eye(N_LABELS)[y]
    for t in range(1, rounds + 1):
        z = w[x].sum(1)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = np.repeat((p - truth) / len(y), N_FEATURES, axis=0)
        grad = np.stack([np.bincount(flat, error[:, k], BUCKETS) for k in range(N_LABELS)], 1) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _edge_weights(unary: np.ndarray, labels: np.ndarray, pairs: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Symmetric potentials that, added to the token parts of an edge's ends, explain their labels best.

    Each edge is a piece of its own; a small penalty draws potentials to 0.
    """
    out = np.zeros((N_LABELS, N_LABELS))
    pairs = pairs[(labels[pairs] >= 0).all(1)]
    if not len(pairs):
        return out
    ends = unary[pairs[:, 0]][:, :, None] + unary[pairs[:, 1]][:, None, :]
    seen = np.zeros_like(out)
    np.add.at(seen, (labels[pairs[:, 0]], labels[pairs[:, 1]]), 1.0)
    for _ in range(rounds):
        z = ends + out
        p = np.exp(z - z.max((1, 2), keepdims=True))
        p /= p.sum((1, 2), keepdims=True)
        grad = seen - p.sum(0)
        out += 2.0 * ((grad + grad.T) / 2 - 0.5 * out) / len(pairs)
    return out


def fit(docs: DataFrame, rounds: int = 150) -> Field | None:
    """Train on a bounded sample of documents, taken in the order of a hash of their keys.

    Of a document with more than ``SAMPLE_TOKENS`` variables a run of so many is taken, from a place that
    a hash of the key draws.
    """
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    order = F.xxhash64("doc_id", F.lit(5))
    ids = told.select("doc_id").where("doc_id is not null").distinct().orderBy(order, "doc_id").limit(SAMPLE_DOCUMENTS)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            some, keys = texts(batch.column("text")), batch.column("doc_id").to_pylist()
            rows = []
            for key, text in zip(keys, some, strict=True):
                draw = random.Random(key)
                tokens, labels = example(text, draw)
                parts = _some(tokens, labels, draw.randrange(max(1, len(labels) - SAMPLE_TOKENS + 1)), SAMPLE_TOKENS)
                rows.append({"doc_id": key} | {n: p.ravel().tolist() for n, p in zip(("labels", "features", "chain", "skip"), parts, strict=True)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), *[(n, pa.list_(pa.int64())) for n in ("labels", "features", "chain", "skip")]]))

    kind = "doc_id long, labels array<long>, features array<long>, chain array<long>, skip array<long>"
    rows = sorted(told.join(F.broadcast(ids), "doc_id").mapInArrow(examples, kind).collect(), key=lambda r: (r.doc_id, r.labels))[:SAMPLE_DOCUMENTS]
    return trained([tuple(np.array(x, np.int64) for x in (r.labels, r.features, r.chain, r.skip)) for r in rows], rounds)


def trained(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 150) -> Field | None:
    """The field from (labels, features, chain, skip) of each document.

    Edges are trained on token parts that the other half of the documents gave, as what the field knows
    of unseen tokens.
    """
    labels = np.concatenate([r[0] for r in rows]) if rows else np.zeros(0, np.int64)
    known = labels >= 0
    if not known.any():
        return None
    x = np.concatenate([r[1].reshape(-1, N_FEATURES) for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    half = np.repeat(np.arange(len(rows)) % 2, sizes)
    unary = np.zeros((len(labels), N_LABELS))
    for k in (0, 1):
        of, other = known & (half == k), half != k
        if of.any():
            unary[other] = _token_weights(x[of], labels[of], rounds)[x[other]].sum(1)
    first = np.cumsum(sizes) - sizes
    chain, skip = (np.concatenate([r[at].reshape(-1, 2) + f for r, f in zip(rows, first.tolist(), strict=True)]) for at in (2, 3))
    return Field(_token_weights(x[known], labels[known], rounds), _edge_weights(unary, labels, chain), _edge_weights(unary, labels, skip))


def _unary(tokens: Tokens, field: Field) -> np.ndarray:
    """The token part of each variable's labels."""
    out = np.zeros((len(tokens.doc), N_LABELS))
    for i in range(0, len(out), EDGE_BLOCK):
        out[i : i + EDGE_BLOCK] = field.weights[tokens.features[i : i + EDGE_BLOCK]].sum(1)
    return out


def _gathered(unary: np.ndarray, target: np.ndarray, message: np.ndarray) -> np.ndarray:
    """The token parts with all messages that reach the tokens."""
    return np.stack([unary[:, k] + np.bincount(target, message[:, k], len(unary)) for k in range(N_LABELS)], 1)


def marginals(tokens: Tokens, field: Field, given: np.ndarray | None = None, rounds: int = ROUNDS) -> np.ndarray:
    """Label marginals of all tokens by damped loopy sum-product over chain and skip edges.

    ``given``: labels that are known, 0 where they are not. Edges are gone through in blocks, so what is
    held beside the messages does not grow with the text.
    """
    belief = unary = _unary(tokens, field)
    if given is not None:
        known = np.flatnonzero(given)
        unary[known] = -GIVEN
        unary[known, given[known]] = 0
    n_chain, n = len(tokens.chain), len(tokens.chain) + len(tokens.skip)
    if n:
        edges = np.concatenate([tokens.chain, tokens.skip])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        parts = [(0, n_chain, field.chain), (n_chain, n, field.skip), (n, n + n_chain, field.chain.T), (n + n_chain, 2 * n, field.skip.T)]
        message, new = np.zeros((2 * n, N_LABELS), np.float32), np.zeros((2 * n, N_LABELS), np.float32)
        for _ in range(rounds):
            for first, last, potential in parts:
                for i in range(first, last, EDGE_BLOCK):
                    block = slice(i, min(i + EDGE_BLOCK, last))
                    back = slice(*(x + n if first < n else x - n for x in (block.start, block.stop)))
                    out = (belief[source[block]] - message[back])[:, :, None] + potential
                    top = out.max(1, keepdims=True)
                    sent = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                    new[block] = DAMPING * message[block] + (1 - DAMPING) * (sent - sent.max(1, keepdims=True))
            message, new = new, message
            belief = _gathered(unary, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(some: list[str], field: Field | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text."""
    base = [base_spans(t) for t in some]
    added: list[list[Span]] = [[] for _ in some]
    tokens = tokens_of(some) if field else None
    if tokens is not None and len(tokens.doc):
        given = _marked(tokens, base)
        p = marginals(tokens, field, given)
        label = np.where((p[:, 0] <= 1 - CERTAIN) & (given == 0), 1 + p[:, 1:].argmax(1), 0)
        linked = np.zeros(len(label), bool)
        linked[tokens.chain[:, 1]] = True
        run: list[int] = []
        for i in [*np.flatnonzero(label).tolist(), None]:
            if run and (i is None or run[-1] != i - 1 or not linked[i] or label[i] != label[run[-1]]):
                d, s, e = int(tokens.doc[run[0]]), int(tokens.start[run[0]]), int(tokens.end[run[-1]])
                text = some[d]
                while s < e and text[s] in _EDGE:
                    s += 1
                while e > s and text[e - 1] in _EDGE:
                    e -= 1
                if s < e:
                    added[d].append((s, int(label[run[0]]) - 1, e))
                run = []
            if i is not None:
                run.append(i)
    return [(b, sorted(b + a)) for b, a in zip(base, added, strict=True)]


def written(spans: list[Span]) -> str:
    """kind:start:end of each span, joined with commas; spans are in order of start, then kind."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    schema = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = all_spans(texts(batch.column("text")), shared.value)
            counts = np.zeros((len(found), len(KINDS)), np.int64)
            for i, (base, _) in enumerate(found):
                for _, k, _ in base:
                    counts[i, k] += 1
            columns = [batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([written(a) for _, a in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(searched, FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with all spans in ``text`` masked and, where the column exists, ``n_chars`` counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names, schema = docs.columns, docs.schema

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in sliced(batches):
            some = batch.column("text").to_pylist()
            spans = [a for _, a in all_spans([t or "" for t in some], shared.value)]
            new = pa.array([t if not s else masked(t, s) for t, s in zip(some, spans, strict=True)], batch.column("text").type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], new, *batch.columns[at + 1 :]], schema=batch.schema)

    out = docs.mapInArrow(clean, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(schema["n_chars"].dataType))
    return out.select(*names)
