"""Secret scans: base patterns, and formats learned from what the base patterns find.

Grammar inference in the manner of state merging: the credentials of one kind make a prefix tree with
counts; states whose outgoing frequencies do not differ by more than a Hoeffding bound are merged, and what
is left is a probabilistic automaton over character classes, with the lengths of its tokens beside it. A
background automaton is learned from long tokens that no base pattern covers. Every candidate token of every
text, or what base spans leave of it, is scored by its likelihood under the formats against the background;
those above a fixed margin are added.
"""
from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from . import words as W

# The base patterns and the least length of what they must hold.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are longest anyway, so shorter ones need not be matched and dropped
LEAST_ASSIGN, LEAST_ACCESS, LEAST_CANDIDATE = 6, 20, 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{LEAST_CANDIDATE},}}")
SAMPLE, MARGIN, LONGEST_SAMPLE = 400, 12.0, 256
ALPHA = 0.05
LEAST_COUNT = 10  # samples that pass a state before it is compared
OTHER_LENGTHS = 0.1  # share of all lengths together that a format never had

_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS_OF = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_WITHIN = np.array([-math.log(len(cs)) for cs in _CLASSES])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end, kind in code points, in order of start, then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def classes(token: str) -> list[int]:
    return [_CLASS_OF[c] for c in token]


class Automaton:
    """A probabilistic automaton: next[state][symbol] is a state; log probabilities of symbols, and of lengths apart.

    Lengths are apart because a loop cannot tell how often it was passed: random digits make one state, whatever
    their number.
    """

    def __init__(self, step: np.ndarray, log: np.ndarray, lengths: np.ndarray):
        self.step, self.log, self.lengths = step, log, lengths

    def score(self, symbols: list[int]) -> float:
        """Log likelihood of a token's classes; a symbol never seen in a state leads back to the start."""
        at, total = 0, 0.0
        for s in symbols:
            total += self.log[at, s] + _WITHIN[s]
            at = self.step[at, s]
        return total + self.lengths[min(len(symbols), len(self.lengths) - 1)]


def _lengths(samples: list[list[int]]) -> np.ndarray:
    """Log probabilities of lengths: as seen, and a small share even over all, so that none is impossible."""
    seen = np.bincount([min(len(s), LONGEST_SAMPLE) for s in samples], minlength=LONGEST_SAMPLE + 1)
    return np.log((1 - OTHER_LENGTHS) * seen / max(1, len(samples)) + OTHER_LENGTHS / (LONGEST_SAMPLE + 1))


def infer(samples: list[list[int]], alpha: float = ALPHA) -> Automaton:
    """State merging over the prefix tree of the samples: red states are final, blue ones are merged or turn red.

    A blue state that enough samples pass merges with the red one that agrees with it in most places, or stays
    apart if all differ. One that few samples pass cannot bear the test: it joins the red state under which what
    follows it is most likely, so that rare paths do not make any state look like the start.
    """
    k = len(_CLASSES)
    counts: list[dict[int, int]] = [defaultdict(int)]
    child, passed = [dict()], [0]
    for sample in samples:
        at = 0
        passed[0] += 1
        for s in sample:
            counts[at][s] += 1
            if s not in child[at]:
                child[at][s] = len(counts)
                counts.append(defaultdict(int))
                child.append({})
                passed.append(0)
            at = child[at][s]
            passed[at] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def agreement(a: int, b: int) -> int:
        """In how many places two states were compared and agree; -1 if they differ in one."""
        pairs, places = [(a, b)], 0
        while pairs:
            a, b = pairs.pop()
            n, m = passed[a], passed[b]
            if n < LEAST_COUNT or m < LEAST_COUNT:
                continue
            wide = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if any(abs(counts[a].get(s, 0) / n - counts[b].get(s, 0) / m) > wide for s in {*counts[a], *counts[b]}):
                return -1
            places += 1
            pairs += [(child[a][s], child[b][s]) for s in sorted(child[b]) if s in child[a] and child[a][s] != child[b][s]]
        return places

    def likelihood(red: int, b: int) -> float:
        """Log likelihood of all that follows b, walked from the red state as far as its paths are known."""
        pairs, total = [(red, b)], 0.0
        while pairs:
            a, b = pairs.pop()
            n = sum(counts[a].values()) + 0.1 * k if a is not None else 0
            for s, m in counts[b].items():
                total += m * math.log((counts[a].get(s, 0) + 0.1) / n if n else 1 / k)
                pairs.append((child[a].get(s) if a is not None else None, child[b][s]))
        return total

    def fold(a: int, b: int) -> None:
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            passed[a] += passed[b]
            for s, n in counts[b].items():
                counts[a][s] += n
            for s, t in child[b].items():
                if s in child[a]:
                    if child[a][s] != t:
                        pairs.append((child[a][s], t))
                else:
                    child[a][s] = t

    red, blue = [0], [(0, s) for s in sorted(child[0])]
    while blue:
        parent, s = max(blue, key=lambda x: passed[child[x[0]][x[1]]])
        node = child[parent][s]
        if passed[node] < LEAST_COUNT:
            into = max(red, key=lambda r: likelihood(r, node))
        else:
            places, into = max(((agreement(r, node), -r) for r in red))
            into = -into if places > 0 else None
        if into is None:
            red.append(node)
        else:
            child[parent][s] = into
            fold(into, node)
        inside = set(red)
        blue = [(r, t) for r in red for t in sorted(child[r]) if child[r][t] not in inside]
    number = {r: i for i, r in enumerate(red)}
    step, log = np.zeros((len(red), k), dtype=np.int64), np.zeros((len(red), k))
    for r, i in number.items():
        total = sum(counts[r].values()) + 0.1 * k
        for s in range(k):
            log[i, s] = math.log((counts[r].get(s, 0) + 0.1) / total)
            step[i, s] = number[child[r][s]] if s in child[r] else 0
    return Automaton(step, log, _lengths(samples))


def _uncovered(text: str, spans) -> list[tuple[int, int]]:
    """Candidate tokens that touch no base span; spans are in order of their starts."""
    starts, reach = [a for a, _, _ in spans], [0, *accumulate((b for _, b, _ in spans), max)]
    found = ((m.start(), m.end()) for m in CANDIDATE.finditer(text))
    return [(a, b) for a, b in found if reach[bisect_left(starts, b)] <= a]  # how far the spans that start before b reach


def _left_over(text: str, spans) -> list[tuple[int, int]]:
    """The stretches that spans leave of candidate tokens, where long enough; spans are in order of their starts."""
    covered: list[list[int]] = []
    for a, b, _ in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    out, i = [], 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while i < len(covered) and covered[i][1] <= at:
            i += 1
        while i < len(covered) and covered[i][0] < end:
            out.append((at, covered[i][0]))
            at = covered[i][1]
            if at >= end:
                break
            i += 1
        out.append((at, end))
    return [(a, b) for a, b in out if b - a >= LEAST_CANDIDATE]


def labelled_tokens(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """kind, token: at most `sample` distinct credentials per base kind, and as many background tokens.

    They are those of least hash in the whole corpus. A task passes on at most twice that many per kind, as the
    least of all are among the least of each task.
    """

    def run(batches):
        least = {kind: {} for kind in ("assign", "access", "hex", "background")}  # token to hash, the least hashes only

        def add(kind: str, token: str) -> None:
            kept = least[kind]
            if len(token) <= LONGEST_SAMPLE and token not in kept:
                h = xxhash.xxh64_intdigest(token)
                if h < limit[kind]:
                    kept[token] = h
                    if len(kept) >= 2 * sample:
                        kept = least[kind] = dict(sorted(kept.items(), key=lambda x: (x[1], x[0]))[:sample])
                        limit[kind] = max(kept.values())

        limit = dict.fromkeys(least, 1 << 64)
        for b in W.parts(batches, 0):
            for text in b.column(0).to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for a, z, kind in spans:
                    add(kind, ASSIGN.match(text[a:z])[2] if kind == "assign" else text[a:z])
                for a, z in _uncovered(text, spans):
                    add("background", text[a:z])
        rows = [(kind, token, h - (1 << 63)) for kind, kept in least.items() for token, h in kept.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.string(), pa.int64()))], names=["kind", "token", "h"])

    found = settle(docs.select(text_col).mapInArrow(run, "kind string, token string, h bigint").distinct())
    parts = [found.where(F.col("kind") == k).orderBy("h", "token").limit(sample) for k in ("assign", "access", "hex", "background")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("kind", "token")


def learn(labelled: DataFrame) -> dict[str, Automaton]:
    """An automaton per kind, each inferred in a task of its own from its bounded sample."""

    def one(group: pa.Table) -> pa.Table:
        tokens = sorted(group.column("token").to_pylist())
        a = infer([classes(t) for t in tokens])
        return pa.table({"kind": group.column("kind")[:1], "states": pa.array([len(a.log)], pa.int64()), "step": pa.array([a.step.astype("<i8").tobytes()], pa.binary()),
                         "log": pa.array([a.log.astype("<f8").tobytes()], pa.binary()), "lengths": pa.array([a.lengths.astype("<f8").tobytes()], pa.binary())})

    rows = labelled.groupBy("kind").applyInArrow(one, "kind string, states bigint, step binary, log binary, lengths binary").collect()  # four automata
    return {r.kind: Automaton(np.frombuffer(r.step, "<i8").reshape(r.states, -1), np.frombuffer(r.log, "<f8").reshape(r.states, -1), np.frombuffer(r.lengths, "<f8")) for r in rows}


def likely(token: str, models: dict[str, Automaton], margin: float = MARGIN) -> bool:
    """Does a credential format explain the token better than the background by the margin?"""
    formats = [m for k, m in models.items() if k != "background"]
    if not formats or "background" not in models:
        return False
    symbols = classes(token)
    return max(m.score(symbols) for m in formats) - models["background"].score(symbols) > margin


def all_spans(text: str, models: dict[str, Automaton], margin: float = MARGIN):
    """Base spans, and all spans: a token, or what base spans leave of one, may be added as kind `format`."""
    base = base_spans(text)
    more = [(a, z, "format") for a, z in _left_over(text, base) if likely(text[a:z], models, margin)]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str, spans, mark: str = "[secret]") -> str:
    """The text with every stretch that spans cover replaced by the mark."""
    out, at = [], 0
    for a, z, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, z)
    return "".join([*out, text[at:]])


def scanned(batches, names: list[str], at: int, models: dict[str, Automaton], margin: float = MARGIN):
    """Arrow batches with the columns that scan() adds; texts in column `at`. Few texts are held at a time."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    listed = lambda spans: [{"kind": k, "start": a, "end": z} for a, z, k in spans]
    for b in W.parts(batches, at):
        base, spans, clean = [], [], []
        for text in b.column(at).to_pylist():
            found, every = all_spans(text or "", models, margin)
            base.append(listed(found))
            spans.append(listed(every))
            clean.append(redact(text, every) if text is not None else None)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, span), pa.array(spans, span), pa.array(clean, pa.string())], names=[*names, "base", "spans", "redacted"])


def scan(docs: DataFrame, text_col: str = "text", margin: float = MARGIN, sample: int = SAMPLE) -> DataFrame:
    """All columns of docs, and base and spans (array of kind, start, end in code points) and redacted (the text without them).

    Outside the base patterns only tokens, and stretches that base spans leave of a token, of 20 characters or
    more are scored: a shorter credential without a base pattern is not found. Formats are learned from whole
    tokens of at most 256 characters; longer ones are scored all the same.

    A null text is empty. Repeated rows are scanned each. Without labelled credentials of any kind, or
    without background tokens, only the base patterns count. Columns of docs that bear an added name are replaced.
    """
    models = docs.sparkSession.sparkContext.broadcast(learn(labelled_tokens(docs, text_col, sample)))  # four small automata
    names = [c for c in docs.columns if c not in ("base", "spans", "redacted")]
    at = names.index(text_col)
    kind = "array<struct<kind: string, start: bigint, end: bigint>>"
    schema = docs.select(*names).schema.add("base", _parsed(kind)).add("spans", _parsed(kind)).add("redacted", "string")

    def run(batches):
        yield from scanned(batches, names, at, models.value, margin)

    return docs.select(*names).mapInArrow(run, schema)


def _parsed(ddl: str):
    from pyspark.sql import types as T
    return T._parse_datatype_string(ddl)
