"""Secret scans: three fixed patterns, and formats learned by grammar inference.

Labelled credentials are the values that the patterns find (a sample of at most ``SAMPLE`` different values of a kind, the first by
hash) and ``MADE`` strings for each well-known format below. For each kind a prefix tree of its strings is folded into a probabilistic
automaton: states whose stopping and next-symbol frequencies, and those of their successors, differ by no more than the Hoeffding bound are
merged (ALERGIA). A candidate is a run of 20 or more characters ``[A-Za-z0-9+/_.=-]`` with a letter and a digit that no pattern's span covers.
It is scored by every automaton against a background of byte pairs counted over all texts, and becomes a span of kind ``format`` if the
best log ratio reaches ``BITS_PER_CHAR`` a character.

Null and empty texts have no spans. Repeated rows are rows of their own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.tables import small_batches, stored
from ledgerloom.llm.words import Texts, text_blocks

KINDS = ("assign", "access", "hex", "format")
SAMPLE, MADE = 500, 200
ALPHA = 0.05
MIN_CANDIDATE = 20
BITS_PER_CHAR = 1.0

_ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_SYMBOLS = string.ascii_letters + string.digits + "+/_.=-"
_CANDIDATE = np.isin(np.arange(256), list(_SYMBOLS.encode()))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_LETTER = np.isin(np.arange(256), list(string.ascii_letters.encode()))
_DIGIT = np.isin(np.arange(256), list(string.digits.encode()))

_ALNUM = string.ascii_letters + string.digits
# Formats of well-known credentials, as parts that are given or drawn (alphabet, length).
FORMATS = {
    "aws-access": ["AKIA", (string.ascii_uppercase + "234567", 16)],
    "aws-secret": [(_ALNUM + "+/", 40)],
    "github": ["ghp_", (_ALNUM, 36)],
    "gitlab": ["glpat-", (_ALNUM + "_-", 20)],
    "google": ["AIza", (_ALNUM + "_-", 35)],
    "slack": ["xoxb-", (string.digits, 12), "-", (string.digits, 12), "-", (_ALNUM, 24)],
    "stripe": ["sk_live_", (_ALNUM, 24)],
    "jwt": ["eyJ", (_ALNUM + "_-", 33), ".eyJ", (_ALNUM + "_-", 60), ".", (_ALNUM + "_-", 43)],
    "hex-32": [("0123456789abcdef", 32)],
    "hex-40": [("0123456789ABCDEF", 40)],
}


def made_credentials() -> dict[str, list[str]]:
    draw = random.Random(5)
    return {name: ["".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=p[1])) for p in parts) for _ in range(MADE)]
            for name, parts in FORMATS.items()}


class Automaton:
    """A probabilistic automaton folded from the prefix tree of sample strings."""

    def __init__(self, strings: list[str]):
        self.seen, self.stop, self.next = [0], [0], [{}]
        for text in sorted(strings):
            state = 0
            self.seen[0] += 1
            for symbol in text:
                edge = self.next[state].get(symbol)
                if edge is None:
                    edge = self.next[state][symbol] = [len(self.next), 0]
                    self.seen.append(0)
                    self.stop.append(0)
                    self.next.append({})
                edge[1] += 1
                state = edge[0]
                self.seen[state] += 1
            self.stop[state] += 1
        self._fold_compatible()

    def _fold_compatible(self) -> None:
        settled, open_ = [0], {(0, s) for s in self.next[0]}
        while open_:
            origin, symbol = max(open_, key=lambda e: (self.seen[self.next[e[0]][e[1]][0]], -e[0], e[1]))
            open_.discard((origin, symbol))
            state = self.next[origin][symbol][0]
            if state in settled:
                continue
            for other in settled:
                if self._compatible(other, state):
                    self.next[origin][symbol][0] = other
                    self._merge(other, state)
                    break
            else:
                settled.append(state)
            known = set(settled)
            open_ = {(s, c) for s in settled for c, (to, _) in self.next[s].items() if to not in known}

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return abs(a / n - b / m) > math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo, met = [(a, b)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in met:
                continue
            met.add((x, y))
            n, m = self.seen[x], self.seen[y]
            if self._differ(self.stop[x], n, self.stop[y], m):
                return False
            for symbol in self.next[x].keys() | self.next[y].keys():
                e, f = self.next[x].get(symbol), self.next[y].get(symbol)
                if self._differ(e[1] if e else 0, n, f[1] if f else 0, m):
                    return False
                if e and f:
                    todo.append((e[0], f[0]))
        return True

    def _merge(self, into: int, state: int) -> None:
        todo = [(into, state)]
        while todo:
            x, y = todo.pop()
            if x == y:
                continue
            self.seen[x] += self.seen[y]
            self.stop[x] += self.stop[y]
            for symbol, (to, n) in self.next[y].items():
                if edge := self.next[x].get(symbol):
                    edge[1] += n
                    todo.append((edge[0], to))
                else:
                    self.next[x][symbol] = [to, n]

    def log2(self, text: str) -> float:
        """Log probability; an unseen step has the chance of half a count spread over all symbols and starts anew."""
        state, out = 0, 0.0
        for symbol in text:
            edge = self.next[state].get(symbol)
            out += math.log2(((edge[1] if edge else 0) + 0.5 / len(_SYMBOLS)) / (self.seen[state] + 0.5))
            state = edge[0] if edge else 0
        return out + math.log2((self.stop[state] + 0.5) / (self.seen[state] + 1))


def learn(values: dict[str, list[str]]) -> list[Automaton]:
    return [Automaton(own) for _, own in sorted(values.items()) if own]


def background(pairs: np.ndarray) -> np.ndarray:
    """log2 chance of a byte after a byte, from pair counts; every pair has half a count more."""
    counts = pairs.reshape(256, 256) + 0.5
    return np.log2(counts / counts.sum(axis=1, keepdims=True))


def _runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of flagged bytes inside one text, of at least so many bytes."""
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads], last[tails] = flags[heads], flags[tails]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = end - start >= least
    return start[long], end[long]


def base_spans(block: Texts) -> list[list[tuple[str, int, int, bytes]]]:
    """For each text its pattern spans as kind, start, end (bytes in the block) and value."""
    raw, n = block.data.tobytes(), len(block)
    low = raw.lower()
    out: list[list] = [[] for _ in range(n)]
    if any(w in low for w in _WORDS) or b"AKIA" in raw:
        for d, (a, z) in enumerate(zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
            if any(low.find(w, a, z) >= 0 for w in _WORDS):
                out[d] += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(raw, a, z) if len(m[2]) >= 8]
            if raw.find(b"AKIA", a, z) >= 0:
                out[d] += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(raw, a, z) if len(m[0]) >= 16]
    start, end = _runs(_HEX[block.data], block.offsets, 32) if len(raw) else ((), ())
    for d, a, z in zip(np.searchsorted(block.offsets, start, "right") - 1, start, end, strict=True):
        out[d].append(("hex", int(a), int(z), raw[a:z]))
    return [sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))) for spans in out]


def _survey(batches):
    """Pattern values, and byte pairs of all texts once a task (key ``pair``, value the pair's number)."""
    pairs = np.zeros(65536, np.int64)
    names = ["key", "value", "n"]
    for block in text_blocks(batches):
        data = block.data.astype(np.int64)
        if len(data) > 1:
            own = data[:-1] * 256 + data[1:]
            inner = np.ones(len(own), bool)
            edges = block.offsets[1:-1]
            inner[edges[(edges > 0) & (edges < len(data))] - 1] = False
            pairs += np.bincount(own[inner], minlength=65536)
        found = sorted({(k, v.decode()) for spans in base_spans(block) for k, _, _, v in spans})
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string()), pa.array([1] * len(found), pa.int64())], names)
    seen = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(["pair"] * len(seen), pa.string()), pa.array([str(k) for k in seen], pa.string()), pa.array(pairs[seen])], names)


def _chances(automata: list[Automaton], table: np.ndarray, value: bytes) -> float:
    """The best automaton's log ratio to the background, in bits a character."""
    codes = np.frombuffer(b" " + value, np.uint8)
    plain = table[codes[:-1], codes[1:]].sum()
    return max((a.log2(value.decode()) for a in automata), default=-math.inf) / len(value) - plain / len(value)


def _scan(model):
    def run(batches):
        automata, table = model.value
        for block in text_blocks(batches):
            spans = base_spans(block)
            raw = block.data.tobytes()
            start, end = _runs(_CANDIDATE[block.data], block.offsets, MIN_CANDIDATE) if raw else ((), ())
            for d, a, z in zip(np.searchsorted(block.offsets, start, "right") - 1, start, end, strict=True):
                own = block.data[a:z]
                if _LETTER[own].any() and _DIGIT[own].any() and not any(s < z and a < e for _, s, e, _ in spans[d]) \
                        and _chances(automata, table, raw[a:z]) >= BITS_PER_CHAR:
                    spans[d].append(("format", int(a), int(z), raw[a:z]))
            lead = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
            told = []
            for d, own in enumerate(spans):
                zero = lead[block.offsets[d]]
                told.append([(k, f"{k}:{lead[a] - zero}:{lead[z] - zero}") for k, a, z, _ in sorted(own, key=lambda s: (s[1], KINDS.index(s[0])))])
            count = lambda kind: pa.array([sum(k == kind for k, _ in own) for own in told], pa.int64())
            base = [",".join(t for k, t in own if k != "format") for own in told]
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id"), count("assign"), count("access"), count("hex"), count("format"),
                pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                pa.array([",".join(t for _, t in own) for own in told], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans"])
    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans`` for every row; offsets are code points."""
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = stored(docs.mapInArrow(_survey, "key string, value string, n long").groupBy("key", "value").agg(F.sum("n").alias("n")), "survey")
    values = made_credentials()
    for kind in KINDS[:3]:
        first = survey.where(F.col("key") == kind).orderBy(F.xxhash64("value"), "value").limit(SAMPLE)
        values[kind] = [r.value for r in first.collect()]
    pairs = np.zeros(65536)
    for row in survey.where("key = 'pair'").collect():  # at most 65,536 rows
        pairs[int(row.value)] = row.n
    model = docs.sparkSession.sparkContext.broadcast((learn(values), background(pairs)))
    return docs.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string")
