"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its context."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ticketlake.llm.common import batches, text_rows

#: The base patterns, in the order of their kinds, with the least length that counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "learned")
#: Words that a base assignment begins with, as they are looked for in lower case.
_STARTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A candidate: a run of these characters of at least this length.
CANDIDATE = re.compile("[A-Za-z0-9+/_.=-]{16,}")
INSIDE, LEFT, RIGHT = 48, 24, 8
# Characters between the views of a candidate that is longer than one: a part of 36 characters lies whole in some view.
STRIDE = 12
WIDTH = LEFT + INSIDE + RIGHT
FILTERS, KERNEL, HIDDEN = 24, 5, 16
# Made labelled findings that the network is trained on, and the share of true ones that the threshold must keep.
FINDINGS, RECALL = 3000, 0.98

_HEXES = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_RUN = bytes(120 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" else 32 for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base findings: leftmost, non-overlapping for each kind, those that are too short dropped."""
    data = text.encode("utf-8", "replace")
    low = data.lower()
    out = []
    if any(s in low for s in _STARTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if b"AKIA" in data:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"x" * LEAST["hex"] in data.translate(_HEXES):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return in_order(out)


def in_order(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int]]:
    data = text.encode("utf-8", "replace")
    if b"x" * 16 not in data.translate(_RUN):
        return []
    return [m.span() for m in CANDIDATE.finditer(text)]


def views(start: int, end: int) -> list[tuple[int, int]]:
    """Parts of a candidate that the network reads: all of it, or INSIDE characters from every STRIDE-th on, to its end."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


def _classes() -> np.ndarray:
    """Character classes: each digit and letter (cases apart in a second channel), each mark of a candidate, and the rest."""
    table = np.full(128, 1, np.int64)
    for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyz"):
        table[ord(c)] = table[ord(c.upper())] = 2 + i
    for i, c in enumerate("+/_.=-:\"'@ "):
        table[ord(c)] = 38 + i
    return table


_CLASS, CLASSES = _classes(), 49


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Class of each character of the left context, the candidate (its first and last characters if it is long) and the
    right context; upper case adds ``CLASSES``; 0 where there is no character."""
    body = text[start:end] if end - start <= INSIDE else text[start : start + INSIDE // 2] + text[end - INSIDE // 2 : end]
    left, right = text[max(0, start - LEFT) : start], text[end : end + RIGHT]
    out = np.zeros(WIDTH, np.int64)
    for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + INSIDE, right)):
        codes = np.array([min(ord(c), 127) for c in part], np.int64)
        upper = (codes >= 65) & (codes <= 90)
        out[at : at + len(part)] = _CLASS[codes] + upper * CLASSES
    return out


@dataclass
class Network:
    """One convolution over class embeddings, largest and mean value of each filter, a hidden layer, a logistic output,
    then a calibrating logistic curve and the threshold on it."""

    filters: np.ndarray  # (KERNEL, 2 * CLASSES, FILTERS): embedding and convolution in one, a sum of table rows
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    last: np.ndarray
    last_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def _forward(self, x: np.ndarray):
        n = x.shape[1] - KERNEL + 1
        z = self.bias + sum(self.filters[k][x[:, k : k + n]] for k in range(KERNEL))
        a = np.maximum(z, 0)
        top = a.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(a, top[:, None, :], 1)[:, 0], a.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return z, top, pooled, h, h @ self.last + self.last_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self._forward(x)[-1] + self.shift, -35, 35)))

    def step(self, x: np.ndarray, y: np.ndarray, moments: list, rate: float, t: int) -> None:
        """One Adam step on the logistic loss."""
        z, top, pooled, h, out = self._forward(x)
        n = z.shape[1]
        d = ((1 / (1 + np.exp(-np.clip(out, -35, 35)))) - y) / len(y)
        g_last, g_last_bias = h.T @ d, d.sum()
        dh = np.outer(d, self.last) * (h > 0)
        g_hidden, g_hidden_bias = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ self.hidden.T
        da = np.repeat(dp[:, None, FILTERS:] / n, n, axis=1)
        np.put_along_axis(da, top[:, None, :], np.take_along_axis(da, top[:, None, :], 1) + dp[:, None, :FILTERS], 1)
        da *= z > 0
        g_filters = np.zeros_like(self.filters)
        for k in range(KERNEL):
            np.add.at(g_filters[k], x[:, k : k + n].reshape(-1), da.reshape(-1, FILTERS))
        grads = [g_filters, da.sum(axis=(0, 1)), g_hidden, g_hidden_bias, g_last, np.array(g_last_bias)]
        names = ["filters", "bias", "hidden", "hidden_bias", "last", "last_bias"]
        for name, g, m in zip(names, grads, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            move = rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
            setattr(self, name, getattr(self, name) - move)


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[str, int, int, bool]]:
    """Findings made by rule, as a reviewer would label them: (text, start, end, is a secret). Half are keys, tokens and
    digests of usual formats; half are mail hosts, card and order numbers, paths, versions, dates, long words and ids."""
    rng = np.random.default_rng(seed)
    low, hexes, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789"
    mixed = low + low.upper() + digits
    draw = lambda chars, a, b: "".join(rng.choice(list(chars), int(rng.integers(a, b + 1))))
    pick = lambda *options: options[int(rng.integers(len(options)))]
    syllables = ("an", "er", "tion", "the", "ble", "ing", "re", "ou", "ver", "sch", "ment", "que", "lich", "do", "ra", "keit")
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))
    secrets = (
        lambda: draw(hexes, 32, 64), lambda: draw(hexes, 40, 40).upper(), lambda: "AKIA" + draw(low.upper() + digits, 16, 16),
        lambda: "ghp_" + draw(mixed, 36, 36), lambda: f"sk_live_{draw(mixed, 24, 32)}", lambda: f"xoxb-{draw(digits, 11, 12)}-{draw(mixed, 24, 24)}",
        lambda: f"eyJ{draw(mixed, 20, 30)}.eyJ{draw(mixed, 30, 40)}.{draw(mixed + '_-', 40, 43)}", lambda: draw(mixed + "+/", 28, 60) + pick("", "=", "=="),
        lambda: draw(mixed, 24, 40), lambda: "AIza" + draw(mixed + "_-", 35, 35), lambda: draw(hexes, 8, 8) + "-" + draw(hexes, 4, 4) + "-" + draw(hexes, 24, 24),
    )
    plain = (
        lambda: f"mail{draw(digits, 1, 2)}.{word()}.example.com", lambda: draw(digits, 16, 19), lambda: draw(digits, 4, 4) + "-" + "-".join(draw(digits, 4, 4) for _ in range(3)),
        lambda: "/".join(word() for _ in range(4)) + f"/{draw(digits, 1, 4)}.html", lambda: f"{word()}_{word()}_{word()}_v{draw(digits, 1, 2)}.{draw(digits, 1, 2)}",
        lambda: f"20{draw(digits, 2, 2)}-0{draw('123456789', 1, 1)}-1{draw(digits, 1, 1)}T0{draw(digits, 1, 1)}", lambda: word() + word() + word() + word() + draw(digits, 1, 2),
        lambda: f"{draw(digits, 3, 3)}.{draw(digits, 3, 3)}.{draw(digits, 3, 3)}.{draw(digits, 3, 3)}/{draw(digits, 2, 2)}", lambda: f"{word()}-{word()}-{draw(digits, 2, 4)}-{word()}-{word()}",
        lambda: f"ISBN-978-{draw(digits, 1, 1)}-{draw(digits, 4, 4)}-{draw(digits, 4, 4)}-{draw(digits, 1, 1)}", lambda: "+" + draw(digits, 2, 2) + "-" + draw(digits, 3, 3) + "-" + draw(digits, 4, 4) + "-" + draw(digits, 4, 4),
        lambda: "=" * int(rng.integers(8, 30)) + draw(digits, 1, 3) + "=" * int(rng.integers(8, 20)), lambda: f"{draw(digits, 1, 3)}." * 5 + draw(digits, 1, 2),
    )
    before = ('token = "', "password: ", "Authorization: Bearer ", "api_key=", "secret: '", "key ", "export KEY=", "")
    out = []
    for i in range(n):
        secret = i % 2 == 0
        body = (pick(*secrets) if secret else pick(*plain))()
        # Either kind is often found in plain text; only some secrets follow a telling word.
        mark = pick("", "", "", "!!", "###", " |", ",", "***")
        lead = f"{word()}{mark} {word()}.{mark} {word()}{mark} "
        lead = (lead.upper() if rng.random() < 0.2 else lead) + (pick(*before) if secret and rng.random() < 0.6 else pick("", "", f"{word()}@" if not secret else "", "id ", "(", '"'))
        text = lead + body + pick(" ", '" ', '"', ". ", "\n", "!! ", "### ", " | ", ", ", "*** ") + word()
        out.append((text, len(lead), len(lead) + len(body), secret))
    return out


@functools.cache
def trained(findings: int = FINDINGS, recall: float = RECALL, seed: int = 5) -> Network:
    """Trains on two thirds of the made findings; on the last third the output is calibrated and the threshold is the
    highest that keeps ``recall`` of the secrets."""
    made = labelled_findings(findings)
    x = np.stack([encode(t, a, b) for t, a, b, _ in made])
    y = np.array([s for *_, s in made], np.float64)
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.1, (KERNEL, 2 * CLASSES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, (2 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 0.2, HIDDEN), 0.0,
    )
    cut = len(made) * 2 // 3
    moments = [[0.0, 0.0] for _ in range(6)]
    t = 0
    for _ in range(6):
        order = rng.permutation(cut)
        for a in range(0, cut, 50):
            t += 1
            net.step(x[order[a : a + 50]], y[order[a : a + 50]], moments, 0.01, t)
    raw, truth = net._forward(x[cut:])[-1], y[cut:]
    slope, shift = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(slope * raw + shift, -35, 35)))
        v = np.stack([raw, np.ones(len(raw))])
        g = v @ (p - truth) + 1e-1 * np.array([slope, shift])
        move = np.linalg.solve((v * np.maximum(p * (1 - p), 1e-4)) @ v.T + 1e-1 * np.eye(2), g)
        slope, shift = slope - float(np.clip(move[0], -1, 1)), shift - float(np.clip(move[1], -1, 1))
    net.slope, net.shift = slope, shift
    scores = np.sort(net.score(x[cut:])[truth == 1])
    net.threshold = float(scores[int(np.floor((1 - recall) * len(scores)))])
    return net


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
_SPAN_TYPE = "struct<kind:string,start:bigint,end:bigint,score:double>"


def find_spans(texts: list[str], net: Network) -> list[list[tuple[str, int, int, float]]]:
    """All findings of each text, in order: base ones, and candidates that the network takes for secrets and that base
    findings don't cover wholly. The score is the network's, also for base findings that meet candidates, else 1."""
    found, rows, places = [], [], []
    for n, text in enumerate(texts):
        base = base_spans(text)
        found.append([[kind, a, b, 1.0] for a, b, kind in base])
        for a, b in candidates(text):
            places.append((n, a, b, len(rows)))
            rows += [encode(text, *view) for view in views(a, b)]
    scores = np.concatenate([net.score(np.stack(rows[i : i + 256])) for i in range(0, len(rows), 256)]) if rows else []
    # A candidate has the highest score of its views.
    highest = np.maximum.reduceat(scores, [first for *_, first in places]) if places else []
    for (n, a, b, _), score in zip(places, highest):
        over = [s for s in found[n] if s[0] != "learned" and s[1] < b and a < s[2]]
        for s in over:
            s[3] = float(score)
        if score >= net.threshold and not covered(a, b, over):
            found[n].append(["learned", a, b, float(score)])
    return [sorted((tuple(s) for s in spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for spans in found]


def covered(start: int, end: int, spans: list) -> bool:
    """Whether the spans (kind, start, end, ...) together hold everything from ``start`` to ``end``."""
    for _, a, b, *_ in sorted(spans, key=lambda s: s[1]):
        if a > start:
            break
        start = max(start, b)
    return start >= end


def _run(net: Network):
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(_SPAN))])

    def rows(it):
        for batch in it:
            ids, texts = batch.column("id").to_pylist(), batch.column("text")
            for at in range(0, len(ids), 500):
                part = texts.slice(at, 500).to_pylist()
                for i, spans in zip(ids[at : at + 500], find_spans(part, net)):
                    yield i, [dict(zip(("kind", "start", "end", "score"), s)) for s in spans]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(schema, rows(it))

    return run, f"id bigint, spans array<{_SPAN_TYPE}>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans (kind, start, end, score; code points, end exclusive, by start, then kind).

    Texts are read whole. Null or empty texts have no spans. Rows that repeat an id, and rows without one, are scanned
    like others; other columns are ignored; an empty table gives an empty result.
    """
    run, schema = _run(trained())
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding replaced by ``mark`` (findings that overlap by one), other columns as they are;
    ``chars_col``, if there is such a column, is the new length of changed texts. No document is dropped; a null text stays null."""
    net = trained()

    def clean(it):
        for batch in it:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            out = []
            for at in range(0, len(texts), 500):
                part = texts[at : at + 500]
                out += [redacted(t, s, mark) for t, s in zip(part, find_spans([t or "" for t in part], net))]
            arrays = dict(zip(batch.schema.names, batch.columns))
            arrays[text_col] = pa.array(out, batch.schema.field(text_col).type)
            if chars_col in arrays:
                changed = [None if new == old else len(new) for new, old in zip(out, texts)]
                old_chars = arrays[chars_col].to_pylist()
                arrays[chars_col] = pa.array([o if c is None else c for c, o in zip(changed, old_chars)], batch.schema.field(chars_col).type)
            yield pa.RecordBatch.from_arrays([arrays[n] for n in batch.schema.names], schema=batch.schema)

    return docs.mapInArrow(clean, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def redacted(text: str | None, spans: list[tuple[str, int, int, float]], mark: str) -> str | None:
    if not text or not spans:
        return text
    out, at = [], 0
    for _, a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]
