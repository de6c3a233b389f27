"""Personal data: base patterns, and a skip-chain conditional random field that labels what the patterns miss.

The field's nodes are a document's tokens that hold a digit or an at sign; all others can't be labelled (names, say, as
nothing here tells them from other words). Adjacent nodes share a potential, and so do distant tokens that repeat or
resemble each other (the same digits, or the same last seven digits, or the same characters), each with the first
observed one, or else the first. Nodes inside base spans are observed, and so are values that follow a credential's
name (secrets, a kind that the field adds). Damped loopy sum-product passes messages over the whole document, however
far apart its tokens are, until they settle. Unary and pair weights are fitted together, by pseudo-likelihood over the
sample's graphs; each node is learnt twice, as it is and as if its shape were unknown, so that the pair weights learn
what neighbours tell by themselves."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeflow.llm.common import table, text_of

#: The contract's kinds, and all.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELS = ("other", *ALL_KINDS)
#: Documents of the sample that the field is fitted on, those with the least hashes of doc_id.
SAMPLE_DOCS = 2000
#: Messages are passed until none changes by more than SETTLED, ROUNDS times at most.
ROUNDS, DAMPING, SETTLED, SURE = 200, 0.5, 1e-4, 0.9
#: In a pseudo-likelihood example, so many neighbours of one label count at most.
NEIGHBOURS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Names of credentials, before a sign of assignment.
_NAMED = re.compile(r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)s?[\"']?[\x20\t]{0,4}[=:][\x20\t]{0,4}[\"']?([A-Za-z0-9+/_.~=-]{16,})", re.I)
_TRIM = ".,;:!?\"'"

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        value = int(x) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """The base spans, ordered, and the places that look like one but fail its check. Every search is linear in the
    text, whatever runs of digits or letters it holds."""
    found: list[Span] = []
    near: list[tuple[int, int]] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts = m[0].split(".")
            place = m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = place + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    found.append((place, 1, end))
                else:
                    near.append((place, end))
                place = end + 1
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19:
            if luhn(digits):
                found.append((m.start(), 2, m.end()))
            else:
                near.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(x.isdigit() and x.isascii() for x in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
            else:
                near.append(m.span())
    return sorted(found), near


def secrets(text: str) -> list[Span]:
    """Values of 16 characters or more, with a letter and a digit, that are assigned to a credential's name."""
    found = [m.span(1) for m in _NAMED.finditer(text)]
    return [(a, KINDS_AT["secret"], b) for a, b in found if any(x.isdigit() for x in text[a:b]) and any(x.isalpha() for x in text[a:b])]


KINDS_AT = {kind: k for k, kind in enumerate(ALL_KINDS)}


@dataclass(frozen=True)
class Node:
    start: int
    end: int
    index: int  # tokens before it that could be nodes, plus gaps: neighbours differ by 1
    features: tuple[int, ...]
    keys: tuple[str, ...]


def _bucket(n: int, ends: tuple[int, ...]) -> int:
    return sum(n >= x for x in ends)


#: Features are groups of one-hot values; their sizes.
GROUPS = (10, 2, 6, 2, 2, 2, 3, 5, 2, 4, 4)


def _features(token: str, before: str) -> tuple[int, ...]:
    digits = sum(x.isdigit() for x in token)
    letters = sum(x.isalpha() for x in token)
    return (
        _bucket(digits, (1, 2, 4, 6, 8, 10, 12, 16, 20)),
        int("@" in token),
        min(5, token.count(".")),
        int("+" in token),
        int("(" in token or ")" in token),
        int("-" in token),
        0 if not letters else 1 if digits + letters == len(token) else 2,
        _bucket(len(token), (4, 8, 16, 24)),
        int("=" in before or ":" in before),
    )


def nodes(text: str) -> list[Node]:
    found: list[Node] = []
    at, index, before = 0, 0, -2
    while m := _SIGN.search(text, at):
        start = m.start()
        while start > before and start > 0 and not _SPACE.match(text, start - 1):
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = gap.start() if gap else len(text)
        a, b = start, end
        while a < b and text[a] in _TRIM:
            a += 1
        while b > a and text[b - 1] in _TRIM:
            b -= 1
        token = text[a:b]
        index += 1 if start == before + 1 else 2
        digits = "".join(x for x in token if x.isdigit())
        keys = [token.lower()]
        if len(digits) >= 7:
            keys += ["=" + digits, "~" + digits[-7:]]
        found.append(Node(a, b, index, _features(token, text[max(0, a - 3) : a]), tuple(dict.fromkeys(keys))))
        before = at = end
    context = [(f.features[0] if f else 0) for f in [None, *found, None]]
    near = lambda k, d: 0 <= k + d < len(found) and found[k + d].index - found[k].index == d
    side = lambda k, d: 1 + min(2, context[k + 1 + d] // 3) if near(k, d) else 0
    return [Node(n.start, n.end, n.index, (*n.features, side(k, -1), side(k, 1)), n.keys) for k, n in enumerate(found)]


def edges(found: list[Node], labels: list[int]) -> list[tuple[int, int, int]]:
    """(node, node, 0 for neighbours or 1 for a skip): each token is tied to the first observed token that shares a key, or else the
    first, so a label is one edge away from all repeats. labels: by observed()."""
    out = [(k, k + 1, 0) for k in range(len(found) - 1) if found[k + 1].index == found[k].index + 1]
    hubs: dict[str, int] = {}
    for k, node in enumerate(found):
        for key in node.keys:
            if key not in hubs or (labels[hubs[key]] <= 0 < labels[k]):
                hubs[key] = k
    for k, node in enumerate(found):
        out += [(min(j, k), max(j, k), 1) for j in sorted({hubs[key] for key in node.keys}) if j != k]
    return sorted(set(out))


def observed(found: list[Node], spans: list[Span], near: list[tuple[int, int]]) -> list[int]:
    """Each node's label by the spans: 0 if it touches none, -1 if unknown because it looks like one that fails its check.

    Spans of one kind don't overlap, so those that touch a node lie between two bounds of the kind's list; near misses
    may overlap each other, and are put together where they do."""
    kinds: dict[int, tuple[list[int], list[int]]] = {}
    for a, k, b in sorted(spans):
        kinds.setdefault(k, ([], []))[0].append(a)
        kinds[k][1].append(b)
    starts, ends = kinds[-1] = ([], [])
    for a, b in sorted(near):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out = []
    for node in found:
        touching = []
        for k, (starts, ends) in kinds.items():
            at = bisect_right(ends, node.start)
            if at < len(starts) and starts[at] < node.end:
                touching.append((starts[at], k))
        sure = sorted(x for x in touching if x[1] >= 0)
        out.append(sure[0][1] + 1 if sure else -1 if touching else 0)
    return out


@dataclass
class Field:
    """unary: feature weights (features x labels); pair: label x label potentials of neighbours and of skips."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, features: np.ndarray, labels: np.ndarray, links: np.ndarray) -> np.ndarray:
        """Loopy sum-product over any number of documents at once: features (nodes x groups), labels (> 0: observed), links (edges x 3)."""
        offsets = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
        own = self.unary[features + offsets].sum(axis=1)
        own -= np.logaddexp.reduce(own, axis=1, keepdims=True)
        fixed = labels > 0
        own[fixed] = -30.0
        own[fixed, labels[fixed]] = 0.0
        if not len(links):
            return np.exp(own)
        # Each edge carries a message either way; the potentials are symmetric.
        source, target = np.concatenate([links[:, 0], links[:, 1]]), np.concatenate([links[:, 1], links[:, 0]])
        back = np.roll(np.arange(len(source)), len(links))
        power = self.pair[np.concatenate([links[:, 2], links[:, 2]])]
        sent = np.zeros((len(source), len(LABELS)))
        for _ in range(ROUNDS):
            held = own.copy()
            np.add.at(held, target, sent)
            arriving = held[source] - sent[back]
            fresh = np.logaddexp.reduce(arriving[:, :, None] + power, axis=1)
            fresh -= np.logaddexp.reduce(fresh, axis=1, keepdims=True)
            moved = np.abs(fresh - sent).max()
            sent = DAMPING * sent + (1 - DAMPING) * fresh
            if moved < SETTLED:
                break
        held = own.copy()
        np.add.at(held, target, sent)
        return np.exp(held - np.logaddexp.reduce(held, axis=1, keepdims=True))


Example = tuple[tuple[int, ...], int, tuple[int, ...]]  # features, label, neighbours' labels by kind of edge


def fit(examples: Counter) -> Field:
    """Softmax regression by gradient steps with momentum: the score of a label is the sum of the unary weights of a node's features and
    the pair weights of its neighbours' labels. The pair weights are kept symmetric."""
    n_labels, n_unary = len(LABELS), sum(GROUPS)
    offsets = np.concatenate([[0], np.cumsum(GROUPS)[:-1]])
    weights = np.zeros((n_unary + 2 * n_labels + 1, n_labels))
    if examples:
        keys = sorted(examples)
        x = np.zeros((2 * len(keys), len(weights)))
        for i, (features, _, around) in enumerate(keys):
            x[i, np.array(features) + offsets] = 1
            x[i, n_unary:-1] = x[len(keys) + i, n_unary:-1] = around
            x[len(keys) + i, -1] = 1  # the shape is unknown: a constant stands for it
        y = np.tile(np.eye(n_labels)[[label for _, label, _ in keys]], (2, 1))
        n = np.tile(np.sqrt(np.array([examples[k] for k in keys], dtype=float)), 2)
        n /= n.sum()
        speed = np.zeros_like(weights)
        for _ in range(800):
            score = x @ weights
            p = np.exp(score - np.logaddexp.reduce(score, axis=1, keepdims=True))
            speed = 0.9 * speed - 0.5 * (x.T @ ((p - y) * n[:, None]) + 1e-4 * weights)
            weights += speed
            for k in (0, 1):
                block = weights[n_unary + k * n_labels : n_unary + (k + 1) * n_labels]
                block[:] = (block + block.T) / 2
    else:
        weights[:n_unary, 0] = 1.0
    return Field(weights[:n_unary], weights[n_unary:-1].reshape(2, n_labels, n_labels))


def examples_of(text: str) -> Counter:
    """The pseudo-likelihood examples of a text's graph: nodes with a known label, and the known labels of their neighbours. A token
    that resembles an observed one but isn't observed itself is no example of anything: its label isn't known."""
    found = nodes(text)
    if not found:
        return Counter()
    spans, near = base_spans(text)
    labels = observed(found, spans + secrets(text), near)
    named = {key for node, label in zip(found, labels, strict=True) if label > 0 for key in node.keys}
    labels = [-1 if label == 0 and named.intersection(node.keys) else label for node, label in zip(found, labels, strict=True)]
    around = np.zeros((len(found), 2, len(LABELS)), dtype=int)
    for a, b, kind in edges(found, labels):
        for one, other in ((a, b), (b, a)):
            if labels[other] >= 0:
                around[one, kind, labels[other]] += 1
    around = np.minimum(around, NEIGHBOURS).reshape(len(found), -1)
    return Counter((node.features, label, tuple(map(int, row))) for node, label, row in zip(found, labels, around, strict=True) if label >= 0)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch the counts that fit() takes, as text: a few thousand rows at most."""
    for batch in batches:
        total: Counter = Counter()
        for text in batch.column("body").to_pylist():
            total.update(examples_of(text))
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(map(str, (k[1], *k[0], *k[2]))) for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["example", "n"])


def trained(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on the base spans of sample_docs documents: the bound of all that reaches the driver."""
    ids = docs.filter(F.col(text).rlike("[0-9@]")).select(F.col(doc_id).alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample_docs)
    body = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body"))
    rows = body.join(F.broadcast(ids.distinct()), "id", "left_semi").select("body").mapInArrow(_examples, "example string, n bigint").groupBy("example").agg(F.sum("n").alias("n")).collect()
    examples: Counter = Counter()
    for row in rows:
        values = tuple(map(int, row["example"].split(" ")))
        examples[(values[1 : 1 + len(GROUPS)], values[0], values[1 + len(GROUPS) :])] += row["n"]
    return fit(examples)


def added_spans(texts: list[str], field: Field, based: list[tuple[list[Span], list[tuple[int, int]]]]) -> list[list[Span]]:
    """For each text the spans that the field adds: tokens outside the given spans with a label of SURE or more, neighbours of one
    label joined. based: for each text the observed spans and the near misses."""
    graphs = [nodes(text) for text in texts]
    labels = [observed(found, *base) for found, base in zip(graphs, based, strict=True)]
    features = np.array([n.features for found in graphs for n in found], dtype=np.int64).reshape(-1, len(GROUPS))
    if not len(features):
        return [[] for _ in texts]
    links, start = [], 0
    for found, known in zip(graphs, labels, strict=True):
        links += [(a + start, b + start, kind) for a, b, kind in edges(found, known)]
        start += len(found)
    flat = np.array([max(0, x) for one in labels for x in one])
    belief = field.marginals(features, flat, np.array(links, dtype=np.int64).reshape(-1, 3))
    best, sure = belief.argmax(axis=1), belief.max(axis=1)
    out, start = [], 0
    for found, known in zip(graphs, labels, strict=True):
        spans: list[Span] = []
        before = -2
        for k, node in enumerate(found):
            label = int(best[start + k])
            if label and known[k] <= 0 and sure[start + k] >= SURE and node.end > node.start:
                if spans and before == node.index - 1 and spans[-1][1] == label - 1:
                    spans[-1] = (spans[-1][0], label - 1, node.end)
                else:
                    spans.append((node.start, label - 1, node.end))
                before = node.index
        out.append(spans)
        start += len(found)
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                piece = batch.slice(part, 256)
                texts = piece.column("body").to_pylist()
                # A text without a digit or an at sign has neither base spans nor nodes.
                some = [i for i, text in enumerate(texts) if _SIGN.search(text)]
                based = [base_spans(texts[i]) for i in some]
                named = [secrets(texts[i]) for i in some]
                more = added_spans([texts[i] for i in some], field, [(own + values, near) for (own, near), values in zip(based, named, strict=True)])
                base: list[list[Span]] = [[] for _ in texts]
                every = [list(x) for x in base]
                n_secret, n_added = [0] * len(texts), [0] * len(texts)
                for i, (own, _), values, extra in zip(some, based, named, more, strict=True):
                    base[i], every[i] = own, sorted(own + values + extra)
                    n_secret[i], n_added[i] = sum(ALL_KINDS[s[1]] == "secret" for s in every[i]), len(extra)
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("id"), *counts, pa.array(map(written, base), pa.string()), pa.array(map(written, every), pa.string()), pa.array(n_secret, pa.int64()), pa.array(n_added, pa.int64())],
                    ["id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_secret", "n_added"],
                )

    return run


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base and spans (kind:start:end, comma-joined, by start and kind; code points),
    n_secret (of all spans) and n_added (spans that only the field found).

    A null or empty text has no spans. Each row is searched by itself, so repeated rows agree, and a row without
    doc_id is searched too. The field is fitted on a bounded sample unless one is given."""
    field = field or trained(docs, doc_id, text)
    body = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("body"))
    kind = body.schema["id"].dataType.simpleString()
    return body.mapInArrow(_found(field), f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string, n_secret bigint, n_added bigint").withColumnRenamed("id", doc_id)


def masked(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, last = [], 0
    for span in filter(None, spans.split(",")):
        kind, a, b = span.split(":")
        if int(a) >= last:
            out += [text[last : int(a)], f"[{kind.upper()}]"]
            last = int(b)
    return "".join([*out, text[last:]])


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of all documents; see find for nulls and repeated rows."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_secret", "n_added", (F.size(F.filter(F.split("spans", ","), lambda x: x != ""))).cast("long").alias("n_spans"))
