"""PII by rules and a character-level bidirectional LSTM with CRF transitions, in numpy.

The rules find e-mail addresses, IP addresses, card and phone numbers of plain form. The network, trained by gradient descent from labelled spans, adds
what is written otherwise (" at ", "dot", other separators). It reads windows of WIDTH characters that overlap by half; the CRF decodes each, and a
character takes its tag from the window in which it stands most central, so spans are reconciled over the whole text. As every kind holds a
digit or an at-sign (or the word "at"), of the windows over the text those are decoded that decide such characters, and their neighbours as far as a
span goes on; the others could add nothing. An added span touches no span of the rules and has the digits or signs that its kind needs.

Positions are code points, ends exclusive. A null or empty text has no spans; rows that repeat get the same spans each; very long texts are
read whole, in windows. Other columns aren't read. Training uses generated sentences with known spans (a fixed seed), no row of the input.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, table

KINDS = ["email", "ip", "card", "phone"]
# The patterns of the base kinds. Runs are possessive and begin where a run begins, which changes no match and keeps time linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

WIDTH, STEP = 64, 32
CHARS = "abcdefghijklmnopqrstuvwxyz0123456789@.-_+()[] :,/"
LETTERS = list("eeeeaaaiiioootttnnnsssrrrhhhllddccuummffppggwwyybbvkxjqz")  # about as often as in prose
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
EMBED, HIDDEN, STEPS, BATCH, RATE, SEED = 12, 24, 600, 32, 0.02, 5


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their at-signs: the local part is the run before the sign, after the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255
    return [m.span() for m in IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


ANY_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of the rules, a list for each kind."""
    digit = ANY_DIGIT.search(text) is not None
    return [emails(text) if "@" in text else [], ips(text) if digit else [], cards(text) if digit else [], phones(text) if digit and "+" in text else []]


# ---- labelled sentences


def sentence(rng) -> tuple[str, list[tuple[int, int, int]]]:
    """Invented words around personal data in many forms, and what looks like them and is none: prose with "at" and "dot", hex runs, dates, versions,
    amounts; spans as (start, end, kind)."""
    word = lambda: "".join(rng.choice(LETTERS, rng.integers(2, 9)))
    name = lambda: "".join(rng.choice(list(CHARS[:26]), rng.integers(3, 10))) if rng.integers(2) else word()
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    text, spans = "", []
    for _ in range(rng.integers(3, 7)):
        start = word()
        text += " ".join([start.capitalize() if rng.integers(3) == 0 else start, *(word() for _ in range(rng.integers(0, 3)))]) + pick(" ", " ", " ", ", ", ": ")
        kind = int(rng.integers(0, 10))
        if kind <= 1:
            at, dot = pick(("@", "."), (" at ", " dot "), (" at ", " dot "), (" at ", " dot "), ("(at)", "."), (" (at) ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" @ ", "."))
            item = name() + pick("", ".", "_") + pick(name(), digits(2), "") + at + name() + pick("", digits(1)) + pick("", "", dot + name()) + dot + pick("com", "org", "net", "de", "io", "uk")
            kind = 0
        elif kind == 2:
            item = pick(" . ", "[.]", "-", ".").join(str(rng.integers(0, 256)) for _ in range(4))
            kind = 1
        elif kind == 3:
            item = pick(" ", "-", "", ".", ".", "/").join(digits(4) for _ in range(4))
            kind = 2
        elif kind <= 5:
            open_, shut = pick(("", pick("-", " ", ".", ".")), ("(", ") "))
            item = pick("+", "00", "", "") + pick("", "", "1 ", digits(2) + " ") + open_ + digits(3) + shut + digits(3) + pick("-", " ", ".") + digits(4)
            kind = 3
        else:
            hexes = "".join(rng.choice(list("0123456789abcdef"), rng.integers(8, 40)))
            text += pick(
                "version " + ".".join(digits(1) for _ in range(3)), "page " + digits(2), "in " + digits(4), digits(3) + "%", hexes, hexes, f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}",
                digits(3) + "," + digits(3), word() + " at " + word() + ". " + word().capitalize(), word() + " at " + word() + ", " + word(), word() + " at " + word(), "the dot " + word(), word() + "." + word(), "ISBN " + digits(10), "$" + digits(2) + "." + digits(2),
            ) + pick(" ", ". ", ", ")
            continue
        spans.append((len(text), len(text) + len(item), kind))
        text += item + pick(" ", " ", ". ", ", ")
    return text, spans


def encode(text: str) -> np.ndarray:
    index = {c: i + 2 for i, c in enumerate(CHARS)}
    return np.array([index.get(c, 1) for c in text.lower()] if len(text.lower()) == len(text) else [index.get(c, 1) for c in text], np.int64)


def labelled(n: int, seed: int):
    """n windows of characters and tags, 0 beyond the text."""
    rng = np.random.default_rng(seed)
    x, y = np.zeros((n, WIDTH), np.int64), np.zeros((n, WIDTH), np.int64)
    for i in range(n):
        text, spans = sentence(rng)
        tags = np.zeros(len(text), np.int64)
        for a, b, kind in spans:
            tags[a], tags[a + 1 : b] = 1 + 2 * kind, 2 + 2 * kind
        at = int(rng.integers(0, max(1, len(text) - WIDTH + 1)))
        part = encode(text)[at : at + WIDTH]
        x[i, : len(part)], y[i, : len(part)] = part, tags[at : at + WIDTH]
    return x, y


# ---- the network

sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def start_values(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    p = {"e": rng.normal(0, 0.3, (len(CHARS) + 2, EMBED)), "o": draw(2 * HIDDEN, TAGS), "c": np.zeros(TAGS), "t": rng.normal(0, 0.1, (TAGS, TAGS))}
    for d in "fb":
        p |= {"w" + d: draw(EMBED, 4 * HIDDEN), "u" + d: draw(HIDDEN, 4 * HIDDEN), "v" + d: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return p


def lstm(p, d: str, x: np.ndarray):
    """x: windows x places x EMBED in reading order. Hidden states, and what the way back needs."""
    n, t, _ = x.shape
    h, c = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    inp = x @ p["w" + d] + p["v" + d]
    hs, kept = np.empty((t, n, HIDDEN)), []
    for k in range(t):
        z = inp[:, k] + h @ p["u" + d]
        gates = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        before, c = (h, c), f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[k] = h
        kept.append((before, i, f, o, g, tc))
    return hs.transpose(1, 0, 2), kept


def lstm_back(p, d: str, x, kept, dh_all, grads):
    n, t, _ = x.shape
    dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
    dz_all = np.empty((t, n, 4 * HIDDEN))
    du = np.zeros_like(p["u" + d])
    for k in range(t - 1, -1, -1):
        (h0, c0), i, f, o, g, tc = kept[k]
        dh = dh + dh_all[:, k]
        dc = dc + dh * o * (1 - tc**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        du += h0.T @ dz
        dh, dc = dz @ p["u" + d].T, dc * f
        dz_all[k] = dz
    dz_all = dz_all.transpose(1, 0, 2)
    grads["u" + d], grads["v" + d] = du, dz_all.sum((0, 1))
    grads["w" + d] = np.einsum("nte,ntz->ez", x, dz_all)
    return dz_all @ p["w" + d].T


def emissions(p, x: np.ndarray):
    e = p["e"][x]
    f, kf = lstm(p, "f", e)
    b, kb = lstm(p, "b", e[:, ::-1])
    h = np.concatenate([f, b[:, ::-1]], axis=2)
    return h @ p["o"] + p["c"], (e, h, kf, kb)


def logsum(a, axis):
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p, x, y):
    """Mean negative log likelihood of the tag sequences under the CRF, and its gradients."""
    em, (e, h, kf, kb) = emissions(p, x)
    n, t, _ = em.shape
    trans, rows = p["t"], np.arange(n)
    fwd, bwd = np.empty_like(em), np.zeros_like(em)
    fwd[:, 0] = em[:, 0]
    for k in range(1, t):
        fwd[:, k] = logsum(fwd[:, k - 1, :, None] + trans, 1) + em[:, k]
    for k in range(t - 2, -1, -1):
        bwd[:, k] = logsum(trans + (em[:, k + 1] + bwd[:, k + 1])[:, None, :], 2)
    z = logsum(fwd[:, -1], 1)
    gold = np.take_along_axis(em, y[:, :, None], 2).sum((1, 2)) + trans[y[:, :-1], y[:, 1:]].sum(1)
    dem = np.exp(fwd + bwd - z[:, None, None])
    pair = np.exp(fwd[:, :-1, :, None] + trans + (em[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
    np.add.at(pair, (y[:, :-1], y[:, 1:]), -1.0)
    for k in range(t):
        dem[rows, k, y[:, k]] -= 1
    dem, pair = dem / n, pair / n
    grads = {"t": pair, "c": dem.sum((0, 1)), "o": np.einsum("nth,ntk->hk", h, dem)}
    dh = dem @ p["o"].T
    de = lstm_back(p, "f", e, kf, dh[:, :, :HIDDEN], grads)
    de = de + lstm_back(p, "b", e[:, ::-1], kb, dh[:, ::-1, HIDDEN:], grads)[:, ::-1]
    grads["e"] = np.zeros_like(p["e"])
    np.add.at(grads["e"], x, de)
    return (z - gold).mean(), grads


@lru_cache(1)
def trained(steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    p = start_values(seed)
    x, y = labelled(5000, seed)
    rng = np.random.default_rng(seed + 1)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.choice(len(x), BATCH, replace=False)
        _, g = loss_and_grads(p, x[at], y[at])
        norm = np.sqrt(sum((a**2).sum() for a in g.values()))
        rate = RATE * (1 - 0.9 * step / steps)
        for k in p:
            a = g[k] * min(1.0, 5.0 / (norm + 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a**2
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return p


def decode(p, x: np.ndarray) -> np.ndarray:
    """Best tag sequence of each window."""
    em, _ = emissions(p, x)
    n, t, k = em.shape
    score, back = em[:, 0], np.empty((t, n, k), np.int64)
    for j in range(1, t):
        step = score[:, :, None] + p["t"]
        back[j] = step.argmax(1)
        score = step.max(1) + em[:, j]
    out = np.empty((n, t), np.int64)
    out[:, -1] = score.argmax(1)
    for j in range(t - 1, 0, -1):
        out[:, j - 1] = back[j][np.arange(n), out[:, j]]
    return out


SIGNS, AT, WIDE = re.compile(r"[0-9@]+"), re.compile(r"[aA][tT](?<!\w..)\b"), re.compile(r"[^\x00-\x7f]+")


def triggers(text: str):
    """What a plausible span must hold: digits of any script, at-signs, the word "at". Searched one by one, as `re` is slow on large sets."""
    for pattern in (SIGNS, AT):
        for m in pattern.finditer(text):
            yield m.span()
    if not text.isascii():
        for m in WIDE.finditer(text):
            if not m[0].isalpha():
                yield from ((k, k + 1) for k in range(*m.span()) if text[k].isdigit())


def decided(k: int, n: int) -> tuple[int, int]:
    """The places that window k decides, of a text of n characters: those that stand more central in it than in its neighbours."""
    return (0 if k == 0 else k * STEP + (WIDTH - STEP) // 2), (n if k * STEP + WIDTH >= n else k * STEP + (WIDTH + STEP) // 2)


def deciding(place: int, n: int) -> int:
    return min(max(0, (place - (WIDTH - STEP) // 2) // STEP), max(0, -(-(n - WIDTH) // STEP)))


def tagged(p, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, end, kind) that the network finds in each text and that hold a trigger: the same as if all windows were decoded."""
    tags: list[dict[int, np.ndarray]] = [{} for _ in texts]
    wanted = {(i, k) for i, text in enumerate(texts) for a, b in triggers(text) for k in range(deciding(a, len(text)), deciding(b - 1, len(text)) + 1)}
    while wanted:
        order, more = sorted(wanted), set()
        for s in range(0, len(order), 512):
            part = order[s : s + 512]
            x = np.zeros((len(part), WIDTH), np.int64)
            for row, (i, k) in zip(x, part):
                piece = encode(texts[i][k * STEP : k * STEP + WIDTH])
                row[: len(piece)] = piece
            for got, (i, k) in zip(decode(p, x), part):
                a, b = decided(k, len(texts[i]))
                tags[i][k] = here = got[a - k * STEP : b - k * STEP]
                # a span may have begun before, or go on
                if k and here[0] and here[0] % 2 == 0:
                    more.add((i, k - 1))
                if here[-1] and b < len(texts[i]):
                    more.add((i, k + 1))
        wanted = {(i, k) for i, k in more if k not in tags[i]}
    out: list[list[tuple[int, int, int]]] = []
    for text, known in zip(texts, tags):
        spans, run = [], []
        for k in sorted(known):
            run.append(known[k])
            if k + 1 not in known:
                left = decided(k, len(text))[1] - sum(map(len, run))
                spans += [(left + u, left + v, kind) for u, v, kind in spans_of(np.concatenate(run))]
                run = []
        out.append(spans)
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, start, kind = [], None, None
    for k, t in enumerate([*tags.tolist(), 0]):
        if start is not None and t != 2 + 2 * kind:
            out.append((start, k, kind))
            start = None
        if t % 2 == 1:
            start, kind = k, t // 2
    return out


# What an added span must look like: spelled-out addresses need a spelled-out dot, the others one without white space behind it.
OPENING, CLOSING = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
SPELLED_DOT = rf"(?:{OPENING}(?:\.|dot){CLOSING}|\s+dot\s+)"
ADDRESS = re.compile(rf"[\w.+%-]+(?:(?:\s?@\s?|{OPENING}(?:@|at){CLOSING})[\w-]+(?:(?:\.|{SPELLED_DOT})[\w-]+)*(?:\.|{SPELLED_DOT})|\s+at\s+[\w-]+(?:(?:\.|{SPELLED_DOT})[\w-]+)*{SPELLED_DOT})[^\W\d_]{{2,}}", re.I)
NUMBER = re.compile(r"[+(]?[0-9](?:[ ()./-]{0,3}[0-9])*")


def plausible(text: str, kind: int) -> bool:
    if kind == 0:
        return ADDRESS.fullmatch(text) is not None
    if kind == 1:
        parts = re.split(r"\s?[\[(]?[.-][\])]?\s?", text)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", x) and int(x) <= 255 for x in parts)
    digits = sum(c in "0123456789" for c in text)
    if not NUMBER.fullmatch(text):
        return False
    if kind == 2:
        return 13 <= digits <= 19 and luhn("".join(c for c in text if c in "0123456789"))
    return 9 <= digits <= 15


def found(p, texts: list[str | None]) -> list[tuple[list[list[tuple[int, int]]], list[tuple[int, int, int]]]]:
    """For each text: the rules' spans by kind, and the added ones."""
    texts = [t or "" for t in texts]
    base = [base_spans(t) for t in texts]
    out = []
    for text, by_kind, more in zip(texts, base, tagged(p, texts)):
        taken = sorted(s for spans in by_kind for s in spans)
        added = []
        for a, b, kind in more:
            while a < b and not text[a].isalnum() and text[a] not in "+(":
                a += 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
            whole = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            if a < b and whole and plausible(text[a:b], kind) and not any(x < b and a < y for x, y in taken):
                added.append((a, b, kind))
        out.append((by_kind, added))
    return out


def rows_of(model):
    def run(batches):
        p = model.value
        for batch in batches:
            for at in range(0, len(batch), 128):
                part = batch.slice(at, 128)
                got = found(p, part["text"].to_pylist())
                counts = [pa.array([len(base[k]) for base, _ in got], pa.int64()) for k in range(4)]
                plain = [",".join(f"{KINDS[k]}:{a}:{b}" for k in range(4) for a, b in base[k]) for base, _ in got]
                full = [",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted([(k, a, b) for k in range(4) for a, b in base[k]] + [(k, a, b) for a, b, k in more])) for base, more in got]
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in plain]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, pa.array(sha), pa.array(full)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame, model: dict | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row for each row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(rows_of(shared), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def op8_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
