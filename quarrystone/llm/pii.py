"""Personal data: exact base patterns, plus a character-level bidirectional LSTM with CRF transitions.

The network is trained in numpy from labelled spans (made-up contexts that hold e-mail addresses, IPs, cards and phone
numbers in many spellings, and look-alikes that are none). It reads a text where one of the four kinds can be at all:
around every digit, every @ and every whole string of the form of an address with spelled-out signs, in any case, as what it
marks elsewhere wouldn't be well-formed. Overlapping windows of a stretch give label scores that are averaged, weighted by the distance from the
window's edge, and one Viterbi pass over the whole stretch reconciles them. What it finds is kept if it is
well-formed (digits, Luhn, parts up to 255) and touches no base span; base spans always stay.

Cases: a null or empty text has no spans; repeated rows get equal results; an empty table gives an empty
result; extra columns are ignored; texts of any length are read whole; positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import read_table, small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, MARGIN = 64, 32, 24
#: Characters on either side of an at sign whose labels decide about the string around it.
NEAR = 8
HIDDEN, EMBED, LABELS, CHARS = 16, 12, 1 + 2 * len(KINDS), 100

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits unless it could at the run's start; the look-behind only saves time
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: An address whose at sign or dots may be spelled out: what stands between its local part and domain (`bare` without a mark of its own), and
#: the domain. A plain point has no blank beside it, or one on both sides after a marked sign: else the end of a sentence would be a domain.
AT = re.compile(r" ?[(\[{] ?at ?[)\]}] ?|(?P<bare> at )| ?@ ?", re.IGNORECASE)
DOT = r" ?[(\[{] ?dot ?[)\]}] ?| dot "
MARKED_DOMAIN, BARE_DOMAIN = (re.compile(rf"[A-Za-z0-9-]++(?:(?:{point}|{DOT})[A-Za-z0-9-]++)*(?:{point}|{DOT})[A-Za-z]{{2,}}+(?![A-Za-z0-9-])", re.IGNORECASE) for point in (r"\.| \. ", r"\."))
SPELLED_DOT = re.compile(DOT, re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of LOCAL+ DOMAIN, leftmost and not overlapping, found from each @: time is linear in the text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [(0, *span) for span in emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _codes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.where((code >= 32) & (code < 127), code - 31, 98)
    out[code == 10] = 96
    out[code >= 0xC0] = 97
    return out.astype(np.int64)


# ---- the network: parameters are a dict of arrays; both directions run as one stacked step


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)
    bias = np.zeros((2, 1, 4 * HIDDEN), np.float32)
    bias[:, :, HIDDEN : 2 * HIDDEN] = 1
    return {"embed": rng.normal(0, 0.5, (CHARS, EMBED)).astype(np.float32), "wx": scale(2, EMBED, 4 * HIDDEN), "wh": scale(2, HIDDEN, 4 * HIDDEN), "b": bias, "out": scale(2 * HIDDEN, LABELS), "ob": np.zeros(LABELS, np.float32), "trans": np.zeros((LABELS, LABELS), np.float32)}


#: tanh of half gives the sigmoid of the three gates, so that one call serves them and the candidate.
HALF = np.repeat(np.array([0.5, 0.5, 0.5, 1.0], np.float32), HIDDEN)


def _forward(p: dict, chars: np.ndarray, keep: bool = False):
    """Label scores (windows, length, labels) of character codes (windows, length)."""
    n, length = chars.shape
    both = np.stack([chars, chars[:, ::-1]])
    x = p["embed"][both]
    gates_x = np.ascontiguousarray(((x @ p["wx"][:, None] + p["b"][:, :, None]) * HALF).transpose(2, 0, 1, 3))
    wh = p["wh"] * HALF
    h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    hs, kept = np.empty((2, n, length, HIDDEN), np.float32), []
    for t in range(length):
        z = np.tanh(gates_x[t] + h @ wh)
        s = z[..., : 3 * HIDDEN] * np.float32(0.5) + np.float32(0.5)
        i, f, o, g = s[..., :HIDDEN], s[..., HIDDEN : 2 * HIDDEN], s[..., 2 * HIDDEN :], z[..., 3 * HIDDEN :]
        before = c
        c = f * c + i * g
        tc = np.tanh(c)
        h = o * tc
        hs[:, :, t] = h
        if keep:
            kept.append((i, f, o, g, before, tc))
    joint = np.concatenate([hs[0], hs[1][:, ::-1]], -1)
    scores = joint @ p["out"] + p["ob"]
    return (scores, (both, x, kept, joint, hs)) if keep else scores


def _crf(scores: np.ndarray, trans: np.ndarray, gold: np.ndarray):
    """Mean negative log likelihood and its gradients by scores and transitions. Messages are scaled to sum to 1 at each step."""
    n, length, k = scores.shape
    top, high = scores.max(2), float(trans.max())
    e, move = np.exp(scores - top[:, :, None]).transpose(1, 0, 2), np.exp(trans - high)
    a, b, c = np.empty((length, n, k), np.float32), np.ones((length, n, k), np.float32), np.empty((length, n), np.float32)
    for t in range(length):
        v = e[t] if t == 0 else (a[t - 1] @ move) * e[t]
        c[t] = v.sum(1)
        a[t] = v / c[t][:, None]
    for t in range(length - 2, -1, -1):
        b[t] = ((e[t + 1] * b[t + 1]) @ move.T) / c[t + 1][:, None]
    z = np.log(c).sum(0) + top.sum(1) + high * (length - 1)
    d_scores = (a * b).transpose(1, 0, 2).copy()
    after = (e[1:] * b[1:]) / c[1:, :, None]
    d_trans = np.einsum("tni,tnj->ij", a[:-1], after) * move
    rows, at = np.arange(n)[:, None], np.arange(length)
    d_scores[rows, at, gold] -= 1
    np.subtract.at(d_trans, (gold[:, :-1], gold[:, 1:]), 1)
    loss = z - scores[rows, at, gold].sum(1) - trans[gold[:, :-1], gold[:, 1:]].sum(1)
    return loss.mean(), d_scores / n, d_trans / n


def _gradients(p: dict, chars: np.ndarray, gold: np.ndarray):
    scores, (both, x, kept, joint, hs) = _forward(p, chars, keep=True)
    loss, d_scores, d_trans = _crf(scores, p["trans"], gold)
    d_scores = d_scores.astype(np.float32)
    grad = {"trans": d_trans, "ob": d_scores.sum((0, 1)), "out": np.tensordot(joint, d_scores, ((0, 1), (0, 1)))}
    d_joint = d_scores @ p["out"].T
    d_h_all = np.stack([d_joint[..., :HIDDEN], d_joint[:, ::-1, HIDDEN:]])
    n, length = chars.shape
    d_h, d_c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
    d_z_all, back = np.empty((2, n, length, 4 * HIDDEN), np.float32), np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
    for t in range(length - 1, -1, -1):
        i, f, o, g, before, tc = kept[t]
        d_h = d_h + d_h_all[:, :, t]
        d_c = d_c + d_h * o * (1 - tc * tc)
        d_z = np.concatenate([d_c * g * i * (1 - i), d_c * before * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], -1)
        d_z_all[:, :, t] = d_z
        d_h, d_c = d_z @ back, d_c * f
    # the state before a step is that after the one before it, and nothing at first
    grad["wh"] = np.stack([np.tensordot(hs[k, :, :-1], d_z_all[k, :, 1:], ((0, 1), (0, 1))) for k in range(2)])
    grad["b"] = d_z_all.sum((1, 2))[:, None]
    grad["wx"] = np.stack([np.tensordot(x[k], d_z_all[k], ((0, 1), (0, 1))) for k in range(2)])
    d_embed = np.zeros_like(p["embed"])
    for k in range(2):
        np.add.at(d_embed, both[k], d_z_all[k] @ p["wx"][k].T)
    grad["embed"] = d_embed
    return loss, grad


def _word(rng: random.Random) -> str:
    word = "".join(rng.choice(["th", "er", "on", "an", "re", "ó", "é", "ch", "ei", "st", "ou", "la", "mi", "ß", "en"]) for _ in range(rng.randint(1, 4)))
    return rng.choice([word, word, word.capitalize(), word.upper()]) + rng.choice(["", "", "", ",", ".", "###", "!!"])


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _entity(rng: random.Random, kind: int) -> str:
    if kind == 0:
        name = rng.choice(["", ".", "_"]).join(_word(rng).strip(",.#!").lower().encode("ascii", "ignore").decode() or "a" for _ in range(rng.randint(1, 2))) + rng.choice(["", "." + _digits(rng, 2), _digits(rng, 1)])
        plain = lambda: _word(rng).strip(",.#!").lower().encode("ascii", "ignore").decode() or "b"
        name = rng.choice([name] * 5 + [plain() * rng.randint(2, 9), rng.choice("abcxyz"), plain().capitalize() + "_" + plain().capitalize()])
        host = rng.choice([rng.choice(["mail", "post", "inbox"]), plain(), plain() + "-" + plain(), plain() * rng.randint(2, 6)]) + rng.choice(["", "", _digits(rng, 1)])
        top = rng.choice(["com", "org", "net", "example.com", plain()[:2] + "." + plain()[:2], plain()[:2], plain()[:4]])
        case = rng.choice([str.lower, str.lower, str.upper])
        at, dot = case(rng.choice([" (at) ", "(at)", "[at]", " [at] ", " at ", " at ", " at ", " ( at ) ", "{at}"])), case(rng.choice([" (dot) ", "(dot)", "[dot]", " [dot] ", " dot ", " ( dot ) ", "{dot}"]))
        top = top.replace(".", rng.choice([dot, "."]))
        return rng.choice([f"{name}@{host}.{top}", f"{name}{at}{host}.{top}", f"{name}{at}{host}{dot}{top}", f"{name}{at}{host}{dot}{top}"])
    if kind == 1:
        return rng.choice([".", ".", ".", "[.]", " . "]).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        n = rng.choice([16, 16, 16, 15, 19])
        d = rng.choice("3456") + _digits(rng, n - 2)
        d += next(c for c in "0123456789" if luhn(d + c))
        mark = rng.choice(["", "", " ", "-", "."])
        return mark.join(d[k : k + 4] for k in range(0, n, 4))
    area, a, b = str(rng.randint(100, 999)), str(rng.randint(100, 999)), _digits(rng, 4)
    return rng.choice([f"+1 ({area}) {a}-{b}", f"+{rng.randint(20, 99)} {area} {a}{b}", f"({area}) {a}-{b}", f"{area}-{a}-{b}", f"{area}.{a}.{b}"])


def _sentences(rng: random.Random) -> list[str]:
    """Prose around " at " that is no address."""
    w = lambda: _word(rng).strip(",.#!")
    return [f"{w()} at {w()}. {w().capitalize()} {w()}", f"{w()} at {_digits(rng, 2)}.{_digits(rng, 1)} percent", f"{w()} at {w()}.{w()[:3]} {w()}", f"{w()}. {w()} at {w()}, {w()}. {w().capitalize()}"]


def _other(rng: random.Random) -> str:
    d = functools.partial(_digits, rng)
    return rng.choice([f"20{d(2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}", f"{d(2)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(1)}", d(rng.randint(1, 9)), f"{d(2)}:{d(2)}", f"#{d(6)}", "".join(rng.choice("0123456789abcdef") for _ in range(40)), f"AKIA{d(4)}XY{d(6)}", f"{d(3)},{d(3)},{d(3)}", f"@{_word(rng)}", "at the dot end", *_sentences(rng)])


def labelled_windows(rng: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and labels (0 other; 1 + 2 kind begins, 2 + 2 kind goes on) of made-up windows."""
    chars, gold = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for row in range(n):
        parts: list[tuple[str, int]] = []
        for _ in range(rng.randint(1, 2)):
            parts += [(_word(rng) + " ", -1) for _ in range(rng.randint(0, 5))]
            kind = rng.choice([0, 0, 1, 2, 3, -1])
            parts.append((_entity(rng, kind) if kind >= 0 else _other(rng), kind))
            parts.append((rng.choice([" ", ", ", ".\n", "### ", " "]), -1))
        parts += [(_word(rng) + " ", -1) for _ in range(12)]
        text = "".join(p for p, _ in parts)
        label = np.zeros(len(text), np.int64)
        at = 0
        for part, kind in parts:
            if kind >= 0:
                label[at : at + len(part)] = 2 + 2 * kind
                label[at] = 1 + 2 * kind
            at += len(part)
        shift = rng.randint(0, max(0, min(len(text) - WINDOW, 40)))
        code, label = _codes(text)[shift : shift + WINDOW], label[shift : shift + WINDOW]
        chars[row, : len(code)], gold[row, : len(label)] = code, label
    return chars, gold


@functools.lru_cache(maxsize=2)
def trained(seed: int = 1, steps: int = 500, batch: int = 48) -> dict[str, np.ndarray]:
    """Parameters after Adam over made-up windows; a pure function of its arguments."""
    rng, rows = np.random.default_rng(seed), random.Random(seed)
    p = _start(rng)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, grad = _gradients(p, *labelled_windows(rows, batch))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * min(1, step / 20) * (0.05 ** (step / steps))
        for k, g in grad.items():
            g = (g * min(1, 5 / (norm + 1e-9))).astype(np.float32)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return p


def viterbi(scores: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of padded stretches (stretches, length, labels)."""
    n, length, k = scores.shape
    back, value = np.zeros((length, n, k), np.int8), scores[:, 0].copy()
    for t in range(1, length):
        through = value[:, :, None] + trans
        back[t] = through.argmax(1)
        step = through.max(1) + scores[:, t]
        live = (t < lengths)[:, None]
        back[t] = np.where(live, back[t], np.arange(k))
        value = np.where(live, step, value)
    out, state = np.zeros((n, length), np.int64), value.argmax(1)
    for t in range(length - 1, -1, -1):
        out[:, t] = state
        state = back[t, np.arange(n), state]
    return out


def spelled(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, start and end of the at sign) of all strings of the form of an address, whatever way its signs are written.

    With a bare " at " and plain points only, as in "look at example.com", a local part of letters alone is a word.
    """
    out, end = [], 0
    for m in AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start() and (domain := (BARE_DOMAIN if m["bare"] else MARKED_DOMAIN).match(text, m.end())):
            if m["bare"] and not SPELLED_DOT.search(domain[0]) and text[start : m.start()].isalpha():
                continue
            end = domain.end()
            out.append((start, end, m.start(), m.end()))
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all places where a kind can be: of digits, of @, and of whole spelled-out addresses."""
    out: list[list[int]] = []
    for start, end in sorted([m.span() for m in TRIGGER.finditer(text)] + [x[:2] for x in spelled(text)]):
        a, b = max(0, start - MARGIN), min(len(text), end + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def label_stretches(p: dict, codes: list[np.ndarray]) -> list[np.ndarray]:
    """Labels of each stretch: window scores averaged by distance from the edge, then one Viterbi pass over the stretch."""
    windows, where = [], []
    for k, code in enumerate(codes):
        for a in range(0, max(1, len(code) - WINDOW + STRIDE), STRIDE):
            part = code[a : a + WINDOW]
            windows.append(np.pad(part, (0, WINDOW - len(part))))
            where.append((k, a, len(part)))
    total = [np.zeros((len(c), LABELS), np.float32) for c in codes]
    weight = [np.zeros((len(c), 1), np.float32) for c in codes]
    ramp = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)[:, None]
    for lo in range(0, len(windows), 512):
        scores = _forward(p, np.array(windows[lo : lo + 512]))
        for (k, a, n), s in zip(where[lo : lo + 512], scores, strict=True):
            total[k][a : a + n] += ramp[:n] * s[:n]
            weight[k][a : a + n] += ramp[:n]
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(codes)
    order = sorted(range(len(codes)), key=lambda k: len(codes[k]))
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and hi - lo < 512 and (hi - lo + 1) * len(codes[order[hi]]) <= 200_000:
            hi += 1
        some = order[lo:hi]
        lengths = np.array([len(codes[k]) for k in some])
        padded = np.zeros((len(some), int(lengths.max()), LABELS), np.float32)
        for row, k in enumerate(some):
            padded[row, : lengths[row]] = total[k] / weight[k]
        for row, (k, best) in enumerate(zip(some, viterbi(padded, p["trans"], lengths), strict=True)):
            out[k] = best[: lengths[row]]
        lo = hi
    return out


def well_formed(kind: int, found: str) -> bool:
    digits = re.sub(r"[^0-9]", "", found)
    if kind == 0:
        return [x[:2] for x in spelled(found)] == [(0, len(found))]
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?: ?\[?\.\]? ?[0-9]{1,3}){3}", found)) and all(int(x) <= 255 for x in re.findall("[0-9]+", found))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ .-]?[0-9])+", found)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"\+?[(0-9][0-9() .-]+[0-9]", found)) and 8 <= len(digits) <= 15 and any(c in found for c in "+-(. ")


def _marked_forms(text: str, at: list[tuple[int, int]], labels: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """Strings of the form of an address that are marked as one around the at sign, in half of the places at least; what their far
    ends are marked as doesn't matter, so they may be longer than a window."""
    forms = spelled(text)
    for (a, b), label in zip(at, labels, strict=True):
        for s, e, first, last in forms[bisect_left(forms, (a,)) : bisect_left(forms, (b,))]:
            near = (label[max(s, first - NEAR) - a : min(e, last + NEAR) - a] + 1) // 2
            if 2 * np.count_nonzero(near == 1) >= len(near):
                yield 0, s, e


def _marked(text: str, at: list[tuple[int, int]], labels: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the spans that the labels mark, without blanks and points at their ends."""
    for (a, _), label in zip(at, labels, strict=True):
        kinds = (label + 1) // 2
        for s in np.flatnonzero((kinds > 0) & ((label % 2 == 1) | (np.diff(kinds, prepend=0) != 0))):
            e = s + 1
            while e < len(label) and label[e] == 2 * kinds[s]:
                e += 1
            inner = text[a + s : a + e]
            yield int(kinds[s]) - 1, int(a + s) + len(inner) - len(inner.lstrip(" ,.;")), int(a + e) - len(inner) + len(inner.rstrip(" ,.;"))


def found_spans(text: str, at: list[tuple[int, int]], labels: list[np.ndarray], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Well-formed spans that touch neither a base span nor one found before nor, on either side, a letter or digit."""
    out: list[tuple[int, int, int]] = []
    for some in (_marked_forms, _marked):
        taken = sorted((a, b) for _, a, b in base + out)
        reach = list(itertools.accumulate((b for _, b in taken), max))  # the furthest end of the spans up to each
        for kind, s, e in some(text, at, labels):
            k = bisect_left(taken, (e, 0))  # spans that start before e
            apart = not (k and reach[k - 1] > s) and not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
            if s < e and apart and well_formed(kind, text[s:e]):
                out.append((kind, s, e))
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trained(seed))  # some thousand numbers

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            at = [stretches(t) for t in texts]
            labels = label_stretches(p, [_codes(t[a:b]) for t, s in zip(texts, at, strict=True) for a, b in s])
            counts, digests, spans, total, k = [[] for _ in KINDS], [], [], [], 0
            said = lambda some: ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in sorted(some))
            for t, s, own in zip(texts, at, base, strict=True):
                every = own + found_spans(t, s, labels[k : k + len(s)], own)
                k += len(s)
                for kind, column in enumerate(counts):
                    column.append(sum(x[0] == kind for x in own))
                digests.append(hashlib.sha256(said(own).encode()).hexdigest())
                spans.append(said(every))
                total.append(len(every))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return given.mapInArrow(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
