"""Personal data: patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns give the base spans. The network reads every text in overlapping
windows of characters and adds spans of its own: written-out addresses, numbers
in unusual forms, and secrets such as keys, tokens and passwords. It is trained
here, in numpy, from labelled spans that `examples` makes; its units use
piecewise linear sigmoids. A character in the overlap of two windows takes the
emissions of the one that sees more around it, so a text has one lattice from
end to end, whose best path Viterbi finds: a span across a seam is decoded as
anywhere else. A path is O and runs of one label between O, so only parts of the
lattice in which some run gains on O are traced; what runs gain is carried from
part to part, so this loses nothing. The overlap is over twice the longest span
of the examples.

Null and empty texts hold nothing. Repeated rows are judged alike, whatever
stands beside them; empty tables give no rows; null ids are kept as they are.
Only texts leave the JVM, so ids are never converted and other columns not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS, "secret")
K = len(LABELS)
HIDDEN = 8  # of each direction
EMBEDDED = 6
WINDOW = 512
OVERLAP = 128
SIDE = OVERLAP // 2  # characters of a window, at a seam, that are the neighbour's
ROUND = 32  # a text's last window is padded to a multiple of this
COLUMNS = 1024  # windows that run together
TOGETHER = 4_000_000  # characters that are cut into windows together
SIGNS = " @.-_+()=\":/,;[]%\n"
LOWER = "abcdefghijklmnopqrstuvwxyz"
PAD, DIGIT, UPPER, LETTER, OTHER = range(5)
CLASSES = 5 + len(LOWER) + len(SIGNS)

# ---- patterns

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WRITTEN_OUT = re.compile(r"(?i)(?<![a-z])at(?![a-z]).*(?:\.|(?<![a-z])dot(?![a-z]))", re.S)
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches; leftmost and not overlapping for each kind."""
    found = []
    last, at = 0, text.find("@")
    while at >= 0:
        # the local part holds no @, so a match begins as far left of its @ as the characters allow
        start = last + len(text[last:at].rstrip(LOCAL))
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        elif start == at or m is None:
            last = max(last, at)  # what stands left of a failed @ cannot be part of a later match
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if 12 <= len(m.group()) <= 38 and 12 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(m.group().count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# ---- the network


def lookup() -> np.ndarray:
    table = np.full(128, OTHER, dtype=np.uint8)
    for i, c in enumerate(LOWER):
        table[ord(c)] = 5 + i
        table[ord(c) - 32] = UPPER
    for i, c in enumerate(SIGNS):
        table[ord(c)] = 5 + len(LOWER) + i
    table[48:58] = DIGIT
    return table


LOOKUP = lookup()


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(code < 128, LOOKUP[np.minimum(code, 127)], LETTER).astype(np.uint8)


def examples(n: int, length: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows: made-up words with spans of each label, and numbers that are none."""

    def some(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(list(alphabet), rng.integers(low, high + 1)))

    def word() -> str:
        w = some("eeettaaooiinnsshhrrddlluccmmfwyppvvbbgkjqxz" + ("éäüñèçßó" if rng.random() < 0.4 else ""), 1, 13)
        w = w.upper() if rng.random() < 0.03 else w.capitalize() if rng.random() < 0.15 else w
        return w + (rng.choice([".", ",", "%%%", "***", "$$$", "&&&", "###", "!!", " |"], p=[0.4, 0.35, 0.03, 0.03, 0.03, 0.03, 0.03, 0.05, 0.05]) if rng.random() < 0.2 else "")

    digits, hexes, mixed = "0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    host = lambda: f"{some(LOWER, 3, 8)}{some(digits, 0, 1)}{rng.choice(['', '.' + some(LOWER, 2, 7)])}.{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"
    name = lambda: some(LOWER, 2, 8) + rng.choice(["", ".", "_"]) + rng.choice([some(digits + LOWER, 1, 3), some(LOWER, 2, 8)])
    parts = lambda sep, low, high, k: sep.join(some(digits, low, high) for _ in range(k))
    makers = {
        1: [lambda: f"{name()}@{host()}", lambda: f"{name()} (at) {host()}", lambda: f"{name()} [at] {host()}"],
        2: [lambda: ".".join(str(rng.integers(1, 256)) for _ in range(4))],
        3: [lambda: "4" + some(digits, 15, 15), lambda: parts(" ", 4, 4, 4), lambda: parts("-", 4, 4, 4), lambda: parts(".", 4, 4, 4)],
        4: [lambda: f"+{some(digits, 1, 2)} ({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}", lambda: f"({some(digits, 3, 3)}) {some(digits, 3, 3)}-{some(digits, 4, 4)}", lambda: parts("-", 3, 3, 2) + "-" + some(digits, 4, 4)],
        5: [lambda: "AKIA" + some(mixed, 16, 16), lambda: f"password={some(hexes, 12, 20)}", lambda: f"password={some(LOWER, 8, 20)}", lambda: f'token = "{some(hexes, 32, 40)}"', lambda: f'token = "{some(LOWER, 16, 40)}"'],
    }
    others = [lambda: some(digits, 1, 6), lambda: f"{some(digits, 1, 2)}.{some(digits, 1, 2)}", lambda: f"{some(digits, 1, 3)},{some(digits, 3, 3)}", lambda: f"20{some(digits, 2, 2)}-{some(digits, 2, 2)}-{some(digits, 2, 2)}", lambda: f"Version {some(digits, 1, 1)}.0", lambda: f"https://www.{host()}/{some(LOWER, 2, 5)}", lambda: f"({word()})", lambda: f'"{word()}"', lambda: f"{word()}:", lambda: f"{word()}={some(LOWER, 2, 6)}"]
    x, y = np.zeros((n, length), dtype=np.uint8), np.zeros((n, length), dtype=np.uint8)
    for i in range(n):
        text, tags = "", []
        while len(text) < length:
            roll = rng.random()
            if roll < 0.09:
                k = int(rng.integers(1, K))
                piece = makers[k][rng.integers(len(makers[k]))]()
            else:
                k, piece = 0, others[rng.integers(len(others))]() if roll < 0.13 else word()
            sep = "\n" if rng.random() < 0.04 else " "
            text += piece + sep
            tags += [k] * len(piece) + [0]
        cut = int(rng.integers(0, 12))
        seen = classes(text[cut : cut + length])
        x[i, : len(seen)], y[i, : len(seen)] = seen, tags[cut : cut + length][: len(seen)]
        if rng.random() < 0.3:
            end = int(rng.integers(8, length))
            x[i, end:], y[i, end:] = PAD, 0
    return x, y


def allowed() -> np.ndarray:
    """A label goes on, begins after O, or ends in O."""
    ok = np.eye(K, dtype=bool)
    ok[0, :] = ok[:, 0] = True
    return ok


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"emb": rng.normal(0, 0.5, (CLASSES, EMBEDDED))}
    for d in "fb":
        p["w" + d] = rng.normal(0, 0.3, (4 * HIDDEN, HIDDEN + EMBEDDED + 1))
        p["w" + d][HIDDEN : 2 * HIDDEN, -1] = 1.0  # remember
        p["e" + d] = rng.normal(0, 0.3, (K, HIDDEN))
    p["e0"] = np.array([2.0] + [-1.0] * (K - 1))
    p["trans"] = np.where(np.eye(K, dtype=bool), 1.0, -1.0)
    return p


def folded(w: np.ndarray) -> np.ndarray:
    """Weights whose sums for the input, forget and output gates are a quarter and a half more: what the gates clip to 0 and 1."""
    w = w.copy()
    w[: 3 * HIDDEN] *= 0.25
    w[: 3 * HIDDEN, -1] += 0.5
    return w


def run_lstm(w: np.ndarray, emb: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, windows) of one direction; x: classes (time, windows). keep: gets what training needs."""
    t_end, n = x.shape
    h4 = HIDDEN
    dtype = w.dtype
    w = folded(w)
    out = np.empty((t_end, h4, n), dtype=dtype)
    inp = np.zeros((h4 + EMBEDDED + 1, n), dtype=dtype)
    inp[-1] = 1
    c, z, act = np.zeros((h4, n), dtype=dtype), np.empty((4 * h4, n), dtype=dtype), np.empty((h4, n), dtype=dtype)
    columns = np.ascontiguousarray(emb.T)
    for t in range(t_end):
        np.take(columns, x[t], axis=1, out=inp[h4:-1], mode="clip")
        np.matmul(w, inp, out=z)
        if keep is not None:
            keep.append((inp.copy(), z.copy(), c.copy()))
        gates = z[: 3 * h4]
        np.clip(gates, 0, 1, out=gates)
        g = z[3 * h4 :]
        np.clip(g, -1, 1, out=g)
        np.multiply(z[:h4], g, out=g)
        np.multiply(c, z[h4 : 2 * h4], out=c)
        np.add(c, g, out=c)
        np.clip(c, -1, 1, out=act)
        np.multiply(act, z[2 * h4 : 3 * h4], out=inp[:h4])
        out[t] = inp[:h4]
    return out


def emissions(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores (time, label, windows)."""
    e = np.matmul(p["ef"], run_lstm(p["wf"], p["emb"], x))
    e += np.matmul(p["eb"], run_lstm(p["wb"], p["emb"], x[::-1]))[::-1]
    e += p["e0"][:, None]
    return e


def _back(w: np.ndarray, keep: list, grad: np.ndarray, x: np.ndarray, g_emb: np.ndarray) -> np.ndarray:
    """Gradient of one direction's weights, from that of its states; adds the embeddings' to g_emb."""
    h = HIDDEN
    g_w, n = np.zeros_like(w), grad.shape[2]
    dh, dc = np.zeros((h, n)), np.zeros((h, n))
    for t in range(len(keep) - 1, -1, -1):
        inp, z, before = keep[t]
        gates = np.clip(z[: 3 * h], 0, 1)
        i, f, o = gates[:h], gates[h : 2 * h], gates[2 * h :]
        g = np.clip(z[3 * h :], -1, 1)
        c = f * before + i * g
        dh = dh + grad[t]
        dc = dc + dh * o * (np.abs(c) < 1)
        dz = np.concatenate([dc * g, dc * before, dh * np.clip(c, -1, 1), dc * i])
        dz[: 3 * h] *= 0.25 * ((z[: 3 * h] > 0) & (z[: 3 * h] < 1))
        dz[3 * h :] *= np.abs(z[3 * h :]) < 1
        g_w += dz @ inp.T
        d_inp = w.T @ dz
        np.add.at(g_emb, x[t], d_inp[h:-1].T)
        dh, dc = d_inp[:h], dc * f
    return g_w


def crf(e: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of labels y (time, windows), and its gradients for scores and transitions."""
    t_end, _, n = e.shape
    tr = np.where(allowed(), trans, -1e4)

    def lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for t in range(1, t_end):
        alpha[t] = lse(alpha[t - 1][:, None] + tr[:, :, None], 0) + e[t]
    for t in range(t_end - 2, -1, -1):
        beta[t] = lse(tr[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
    total = lse(alpha[-1], 0)
    at, cols = np.arange(t_end)[:, None], np.arange(n)[None]
    gold = e[at, y, cols].sum(0) + tr[y[:-1], y[1:]].sum(0)
    g_e = np.exp(alpha + beta - total)
    g_t = np.zeros((K, K))
    for t in range(1, t_end):
        g_t += np.exp(alpha[t - 1][:, None] + tr[:, :, None] + (e[t] + beta[t])[None] - total).sum(-1)
    np.subtract.at(g_e, (at, y, cols), 1)
    np.subtract.at(g_t, (y[:-1], y[1:]), 1)
    return float((total - gold).mean()), g_e / n, np.where(allowed(), g_t, 0) / n


@lru_cache(maxsize=4)
def trained(steps: int = 260, batch: int = 96, length: int = 72, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """The network's weights; the same in every process."""
    rng = np.random.default_rng(seed)
    p = start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    xs, ys = examples(24 * batch, length, rng)
    for step in range(steps):
        pick = rng.choice(len(xs), batch, replace=False)
        x, y = xs[pick].T.copy(), ys[pick].T.astype(np.int64)
        keep_f, keep_b = [], []
        h_f = run_lstm(p["wf"], p["emb"], x, keep_f)
        h_b = run_lstm(p["wb"], p["emb"], x[::-1], keep_b)
        e = np.matmul(p["ef"], h_f) + np.matmul(p["eb"], h_b)[::-1] + p["e0"][:, None]
        _, g_e, g_t = crf(e, p["trans"], y)
        g = {"trans": g_t, "e0": g_e.sum((0, 2)), "emb": np.zeros_like(p["emb"])}
        g["ef"], g["eb"] = np.einsum("tkn,thn->kh", g_e, h_f), np.einsum("tkn,thn->kh", g_e[::-1], h_b)
        g["wf"] = _back(p["wf"], keep_f, np.matmul(p["ef"].T, g_e), x, g["emb"])
        g["wb"] = _back(p["wb"], keep_b, np.matmul(p["eb"].T, g_e)[::-1], x[::-1], g["emb"])
        norm = np.sqrt(sum((q * q).sum() for q in g.values()))
        lr = rate * min(1.0, 3 * (1 - step / steps))
        for k in p:
            q = g[k] * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * q
            v[k] = 0.99 * v[k] + 0.01 * q * q
            p[k] = p[k] - lr * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-8)
    return {k: np.ascontiguousarray(x, dtype=np.float32) for k, x in p.items()}


# ---- decoding


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (time, windows) of scores (time, label, windows)."""
    t_end, _, n = e.shape
    stay = np.diag(trans)[:, None].copy()
    into, out = trans[0][:, None], trans[:, 0][:, None]
    score = e[0].copy()
    from_o = np.zeros((t_end, K, n), dtype=bool)  # for a label: whether O came before it
    before = np.zeros((t_end, n), dtype=np.uint8)  # for O: which label came before it
    for t in range(1, t_end):
        leave = score + out
        before[t] = leave.argmax(0)
        begin, go = score[:1] + into, score + stay
        from_o[t] = begin > go
        score = np.maximum(begin, go)
        score[0] = leave.max(0)
        score += e[t]
    labels = np.empty((t_end, n), dtype=np.uint8)
    now, cols = score.argmax(0).astype(np.uint8), np.arange(n)
    for t in range(t_end - 1, -1, -1):
        labels[t] = now
        if t:
            now = np.where(now == 0, before[t], np.where(from_o[t][now, cols], 0, now))
    return labels


def windows_of(n: int) -> list[tuple[int, int]]:
    """Start and padded length of the windows of n characters."""
    step, out, at = WINDOW - OVERLAP, [], 0
    while True:
        left = n - at
        if left <= WINDOW:
            return [*out, (at, -(-left // ROUND) * ROUND)]
        out.append((at, WINDOW))
        at += step


def gains(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What runs of a label add to a path of O alone, in parts of lattices (time, label, parts).

    For each label but O and each part: the sum of going on through the part,
    the best run that ends at its last character and begins in it, the best that
    ends anywhere in it and begins in it, and the most that going on adds up to
    some character. Beginnings are counted, ends are not.
    """
    begin, stay = ((v - trans[0, 0])[:, None] for v in (trans[0, 1:], np.diag(trans)[1:]))
    gain = e[0, 1:] - e[0, :1]
    through = gain + stay
    run, up = gain + begin, through.copy()
    most = run.copy()
    for now in e[1:]:
        np.subtract(now[1:], now[:1], out=gain)
        run += stay
        np.maximum(run, begin, out=run)
        run += gain
        np.maximum(most, run, out=most)
        gain += stay
        through += gain
        np.maximum(up, through, out=up)
    return through, run, most, up


def parts_to_trace(of: np.ndarray, part: np.ndarray, found: tuple[np.ndarray, ...], end: np.ndarray) -> np.ndarray:
    """Which parts hold characters of a run that gains on O. of: text of each part; part: its number in the text; found: gains() of the parts, labels first."""
    through, last, most, up = found
    keep = np.zeros(len(of), dtype=bool)
    state = np.full((len(end), of.max() + 1), -np.inf)  # the best run that ends where the part begins
    since = np.zeros(state.shape, dtype=np.int64)  # and the part it begins in
    place = {}
    for n in range(part.max() + 1):
        here = np.flatnonzero(part == n)
        texts = of[here]
        place[n] = dict(zip(texts.tolist(), here.tolist()))
        keep[here] |= (most[:, here] + end[:, None] > 0).any(axis=0)
        crossing = state[:, texts] + up[:, here] + end[:, None] > 0
        for label, k in zip(*np.nonzero(crossing)):
            for m in range(since[label, texts[k]], n + 1):
                keep[place[m][int(texts[k])]] = True
        on = state[:, texts] + through[:, here]
        begun = last[:, here] >= on
        state[:, texts] = np.maximum(on, last[:, here])
        since[:, texts] = np.where(begun, n, since[:, texts])
    return keep


Part = tuple[int, int, int, int, int, int]  # text, number in the text, start and length of its window, and where the part begins and ends in that


def parts_of(seen: list[np.ndarray]) -> list[Part]:
    out = []
    for i, s in enumerate(seen):
        windows = windows_of(len(s)) if len(s) else []
        for n, (at, length) in enumerate(windows):
            final = n == len(windows) - 1
            out.append((i, n, at, length, SIDE if n else 0, len(s) - at if final else WINDOW - SIDE))
    return out


def part_emissions(p: dict[str, np.ndarray], seen: list[np.ndarray], some: list[Part]) -> np.ndarray:
    """Emissions (time, label, parts) of the windows of parts of one length; beyond a part's end there is O."""
    length = some[0][3]
    x = np.full((len(some), length), PAD, dtype=np.uint8)
    for row, (i, _, at, _, _, _) in zip(x, some):
        piece = seen[i][at : at + length]
        row[: len(piece)] = piece
    e = emissions(p, np.ascontiguousarray(x.T))
    high = np.array([part[5] for part in some])
    if high.min() < length:
        after = np.arange(length)[:, None] >= high
        e[:, 0][after] = 0
        e[:, 1:] = np.where(after[:, None], np.float32(-1e4), e[:, 1:])
    return e


def together(parts: list[Part], places: list[int]) -> Iterator[list[int]]:
    """Places of parts that run together: of windows of one length, beginning at one place in them, and ending at one place unless their texts end there."""
    groups: dict[tuple[int, int, bool], list[int]] = {}
    for k in places:
        groups.setdefault((parts[k][3], parts[k][4], parts[k][5] == WINDOW - SIDE), []).append(k)
    for group in groups.values():
        for at in range(0, len(group), COLUMNS):
            yield group[at : at + COLUMNS]


def to_trace(p: dict[str, np.ndarray], seen: list[np.ndarray], parts: list[Part]) -> np.ndarray:
    """Which parts of the lattices hold characters of a run that gains on O."""
    found = np.empty((4, K - 1, len(parts)), dtype=np.float32)
    for some in together(parts, list(range(len(parts)))):
        e = part_emissions(p, seen, [parts[k] for k in some])
        found[:, :, some] = gains(e[parts[some[0]][4] : max(parts[k][5] for k in some)], p["trans"])
    of, number = (np.array([part[c] for part in parts]) for c in (0, 1))
    return parts_to_trace(of, number, tuple(found), p["trans"][1:, 0] - p["trans"][0, 0])


def trace(p: dict[str, np.ndarray], pieces: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of pieces of lattices (time, label) that stand between O."""
    out: list[np.ndarray] = [np.zeros(0, dtype=np.uint8)] * len(pieces)
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    at = 0
    while at < len(order):
        size = -(-(len(pieces[order[at]]) + 2) // ROUND) * ROUND
        some = [i for i in order[at : at + COLUMNS] if len(pieces[i]) + 2 <= size]
        e = np.full((size, K, len(some)), -1e4, dtype=np.float32)
        e[:, 0] = 0
        for col, i in enumerate(some):
            e[1 : 1 + len(pieces[i]), :, col] = pieces[i]
        labels = viterbi(e, p["trans"])
        for col, i in enumerate(some):
            out[i] = labels[1 : 1 + len(pieces[i]), col]
        at += len(some)
    return out


def label_texts(p: dict[str, np.ndarray], texts: list[str]) -> dict[int, np.ndarray]:
    """For each text (by place) with any label, its characters' labels: the best path of its whole lattice."""
    seen = [classes(t) for t in texts]
    parts = parts_of(seen)
    if not parts:
        return {}
    kept = np.flatnonzero(to_trace(p, seen, parts)).tolist()
    lattice: dict[int, np.ndarray] = {}
    for some in together(parts, kept):
        e = part_emissions(p, seen, [parts[k] for k in some])
        lattice |= {k: e[parts[k][4] : parts[k][5], :, col].copy() for col, k in enumerate(some)}
    runs: list[list[int]] = []
    for k in kept:  # parts side by side are traced as one
        if runs and runs[-1][-1] == k - 1 and parts[k][1]:
            runs[-1].append(k)
        else:
            runs.append([k])
    out: dict[int, np.ndarray] = {}
    for run, labels in zip(runs, trace(p, [np.concatenate([lattice[k] for k in r]) for r in runs])):
        if labels.any():
            i, _, at, _, low, _ = parts[run[0]]
            out.setdefault(i, np.zeros(len(texts[i]), dtype=np.uint8))[at + low : at + low + len(labels)] = labels
    return out


def plausible(kind: int, piece: str) -> bool:
    """What a pattern's own test would drop, such as a card number that fails its check digit, is not added either.

    An address needs an @, a written-out at with a dot after it, or a digit; a secret is taken as the network reads it.
    """
    digits = NOT_DIGIT.sub("", piece)
    if KINDS[kind : kind + 1] == ("card",):
        return 12 <= len(digits) <= 19 and luhn(digits)
    if KINDS[kind : kind + 1] == ("ip",):
        parts = [x for x in NOT_DIGIT.split(piece) if x]
        return len(parts) == 4 and all(int(x[:9]) <= 255 for x in parts)
    if KINDS[kind : kind + 1] == ("phone",):
        return 9 <= len(digits) <= 15
    return KINDS[kind : kind + 1] != ("email",) or bool(digits) or "@" in piece or WRITTEN_OUT.search(piece) is not None


def added_spans(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Plausible runs of one label, five characters or more without white space and stops at their ends, that meet no base span."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], labels, [0]])))
    taken, out = np.zeros(len(text) + 1, dtype=bool), []
    for s, _, t in base:
        taken[s:t] = True
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        kind = int(labels[a])
        if kind:
            piece = text[a:b]
            a, b = a + len(piece) - len(piece.lstrip()), b - len(piece) + len(piece.rstrip(" \n\t\r.,;"))
            if b - a >= 5 and not taken[a:b].any() and plausible(kind - 1, text[a:b]):
                out.append((a, kind - 1, b))
    return out


def find(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", weights: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, and spans: an array of (kind, start, end, base) in order of their start; offsets in code points."""
    p = weights or trained()
    names = (*KINDS, "secret")

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,base:boolean>>")
    def spans_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [t if isinstance(t, str) else "" for t in part]
            rows, at = [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= TOGETHER):
                    held += len(texts[end])
                    end += 1
                labels = label_texts(p, texts[at:end])
                for i, t in enumerate(texts[at:end]):
                    base = base_spans(t)
                    spans = [(*s, True) for s in base]
                    if i in labels:
                        spans = sorted(spans + [(*s, False) for s in added_spans(t, labels[i], base)])
                    rows.append([{"kind": names[k], "start": s, "end": e, "base": b} for s, k, e, b in spans])
                at = end
            yield pd.Series(rows, dtype=object)

    return docs.select(docs[doc_id].alias("doc_id"), spans_of.asNondeterministic()(docs[text]).alias("spans"))
