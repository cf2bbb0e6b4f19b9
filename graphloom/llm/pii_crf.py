"""Personal data: exact patterns, and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_batches, slices

#: Kinds of the base patterns, and the one that the field alone finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))

#: An address is what stands before an at-sign, as far as it goes, and a domain after it.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: Runs of digits are taken whole: a match that fails at the start of a run fails within it.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Long mixtures of letters and digits are one token.
_TOKEN = re.compile(r"(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{20,}+|[0-9]+|[^\W\d_]+|[^\w\s]|_|\S")
#: Words that a sequence is built around: with a digit, an at-sign or a spelled-out one.
_TRIGGER = re.compile(r"[0-9@]|[\[(](?:at|dot)[\])]", re.I)
_AROUND = re.compile(r"\S+")

#: The labelled table: texts with marked spans. Shapes matter, not the characters.
LABELLED = """
write to <email>jane.doe@mail3.example.com</email> about it
her address is <email>j_doe+news@uni.example.org</email>, as before.
mail <email>info@example.net</email>
the user <email>root@localhost</email> logged in
send it to <email>anna [at] example [dot] com</email> today
ask <email>tom.lee (at) mail (dot) example (dot) org</email> or me
reach <email>maria[at]example.net</email> soon
escribe a casa.<email>luz.9@correo.example.com</email> hoy mismo
SEND!! <email>KAI.77@POST.EXAMPLE.NET</email>!! NOW!!
we meet @ noon near the hall
follow @someuser for more
rate @ 12 per unit
from <ip>192.168.10.7</ip> to the server
hosts <ip>10.0.0.1</ip> and <ip>172.16.254.3</ip> were up
der server <ip>91.3.44.210</ip> war aus
FAILED!! <ip>203.0.113.77</ip>!! AT!!
see section 3.2.1 of the text
licensed under version 4.0.
version 2.0.13 was released
it was 999.800.700.600 of them
release 1.2.3.4.5 is out
rates of 12.5 and 7.25 percent
pay with <card>4111 1111 1111 1111</card> please
the card <card>5500-0000-0000-0004</card> is lost
card number <card>{L}</card> was used
numéro <card>{L}</card> merci
mit <card>{L}</card> bezahlt
PAY!! <card>{L}</card>!! HERE!!
paid%%% <card>{L}</card>$$$ by&&&
order {X} was sent
los números {X} en lista
le colis {X} êtait parti
PARCEL!! {X}!! CAME!!
lot&&& {X}$$$ neu&&&
parcel 123456789012 arrived
isbn 978-3-16-148410-0 in print
call <phone>+1 (312) 555-0188</phone> now
oder <phone>+49 30 901820</phone> und so
desk <phone>+1 (206) 555-0121</phone> is open
ring <phone>+1 (415) 555-0163</phone>%%% of
call me on <phone>(312) 555-0188</phone> today
tel <phone>(040) 555-0199</phone>.
phone: <phone>312-555-0188</phone>
her phone is <phone>030-555-0134</phone> at home
fax <phone>312.555.0188</phone> or mail
mobile <phone>0171 555 7713</phone>
tel. <phone>040 5550199</phone>
call <phone>555-0134</phone> at once
the years 1914-1918 and 1939-1945
on 2024-01-15 at 10:30 they met
dated 15.01.2024 and 3/4/2023
(2019) 12 pages, 4-7
it costs $12.50 or 13,000 euros
pages 120-135 of volume 12
in 1999 they had 20 or 30 of them
chapter 12 verse 3-4
room 101 and 102 are full
a ratio of 16:9 in 1080p
token = "<secret>{H}</secret>" is set
TOKEN = "<secret>{H}</secret>"!! DONE!!
the token="<secret>{H}</secret>"%%% and
api_key: <secret>{H}</secret> in the file
secret = '<secret>{M}</secret>' ok
export PASSWORD=<secret>{M}</secret> first
client secret "<secret>{M}</secret>" was leaked
commit {H} was merged
file {H} has this sum
sum {M} of the file
{H} files changed
key 0x7fff5694dc58 at line 42
sha1 {H} done
id 550e8400-e29b-41d4-a716-446655440000 was made
bus 42 leaves at 7.30 from stop 3
score 3-1 and 2-2 after 90 minutes
30% of 12,345 people in 2020
lot 12345 sold for 1 200 000
http://example.com/en/123?page=2 was read
article 7 (2) and 12 (3)
""".strip().splitlines()  # fmt: skip
#: What stands for {L} and {X}, numbers that pass and fail Luhn's test, and for {H} and {M}, long mixtures of letters and digits.
_FILL = {"{L}": "4111111111111111", "{X}": "9807915762804490", "{H}": "0123456789abcdef0123456789abcdef01234567", "{M}": "Ab3De5Gh7Jk9Mn2Pq4St6"}
_LEXICON = {w: "call" for w in ("tel", "phone", "call", "fax", "mobile", "cell", "telefon", "téléphone", "teléfono")} | {w: "mail" for w in ("mail", "email", "e-mail")} | {w: "key" for w in ("token", "secret", "password", "passwd", "key", "apikey", "credential")} | {"at": "at", "dot": "dot"}
_SEED_ROUNDS, _RATE, _DECAY = 150, 0.1, 0.002


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the patterns, leftmost and non-overlapping per kind, sorted by start and kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), 0))
        end = found.end() if found else at + 1
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def sequences(text: str) -> list[list[re.Match]]:
    """The tokens of the stretches that the field labels: words with a trigger and two words around, merged where they meet."""
    if not _TRIGGER.search(text):
        return []
    out: list[list[re.Match]] = []
    end = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < end:
            continue
        lo = hi = m.start()
        for _ in range(3):
            while lo and text[lo - 1].isspace():
                lo -= 1
            while lo and not text[lo - 1].isspace():
                lo -= 1
        for k in range(3):
            while hi < len(text) and not text[hi].isspace():
                hi += 1
            if k < 2:
                while hi < len(text) and text[hi].isspace():
                    hi += 1
        lo = max(lo, end)
        found = list(_TOKEN.finditer(text, lo, hi))
        if out and lo == end:
            out[-1] += found
        else:
            out.append(found)
        end = hi
    return out


def shape(token: str) -> str:
    c = token[0]
    if len(token) >= 20 and token.isascii() and not token.isalpha() and not token.isdigit():
        return "X"
    if "0" <= c <= "9" and token.isascii():
        n = len(token)
        if 14 <= n <= 19:
            return "N" + "xL"[luhn(token)]
        return f"d{n}" + ("b" if n == 3 and token > "255" else "") if n < 14 else "D"
    if c.isalpha():
        known = _LEXICON.get(token.lower())
        if known:
            return known
        case = "A" if token.isupper() else "a" if token.islower() else "Aa"
        return case + ("1" if len(token) == 1 else "2" if len(token) < 4 else "")
    return c if c < "\x7f" else "^"


def _features(seq: list[re.Match]) -> Iterator[tuple[str, ...]]:
    shapes = ["<s>", *(shape(m[0]) for m in seq), "</s>", "</s>"]
    for i, m in enumerate(seq, 1):
        gap = "_" if i == 1 or seq[i - 2].end() < m.start() else "."
        after = "_" if i == len(seq) or m.end() < seq[i].start() else "."
        before2 = shapes[i - 2] if i > 1 else "<s>"
        yield (
            f"s={shapes[i]}", f"g={gap}{shapes[i]}{after}", f"p={shapes[i - 1]}{gap}{shapes[i]}", f"n={shapes[i]}{after}{shapes[i + 1]}",
            f"q={shapes[i - 1]}{gap}", f"t={shapes[i - 1]}{gap}{shapes[i]}{after}{shapes[i + 1]}", f"u={before2}|{shapes[i - 1]}{gap}{shapes[i]}", f"v={shapes[i]}{after}{shapes[i + 1]}|{shapes[i + 2]}",
        )


def _parse(line: str) -> tuple[list[re.Match], list[int]]:
    text, spans = "", []
    for short, full in _FILL.items():
        line = line.replace(short, full)
    for part in re.split(r"(<\w+>[^<]*</\w+>)", line):
        if m := re.fullmatch(r"<(\w+)>([^<]*)</\w+>", part):
            spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
            text += m[2]
        else:
            text += part
    tokens = list(_TOKEN.finditer(text))
    tags = [0] * len(tokens)
    for a, b, k in spans:
        own = [i for i, t in enumerate(tokens) if a <= t.start() and t.end() <= b]
        for i in own:
            tags[i] = 2 + 2 * k
        tags[own[0]] = 1 + 2 * k
    return tokens, tags


def _allowed() -> np.ndarray:
    """Transitions: an inside label follows only its kind."""
    ok = np.zeros((len(LABELS), len(LABELS)))
    for b, name in enumerate(LABELS):
        if name[0] == "I":
            ok[:, b] = -1e4
            ok[b - 1, b] = ok[b, b] = 0
    return ok


class WordShapeCRF:
    """Weights of features by label and of transitions; fitted by maximum penalised likelihood."""

    def __init__(self, labelled: list[str] = LABELLED):
        pairs = [_parse(x) for x in labelled]
        feats = [list(_features(t)) for t, _ in pairs]
        self.index: dict[str, int] = {}
        for f in feats:
            for fs in f:
                for x in fs:
                    self.index.setdefault(x, len(self.index))
        k, n = len(LABELS), max(len(f) for f in feats)
        self.emit, self.move = np.zeros((len(self.index), k)), np.zeros((k, k))
        fixed = _allowed()
        ids = [(s, t, self.index[x]) for s, f in enumerate(feats) for t, fs in enumerate(f) for x in fs]
        seq, pos, feat = (np.array(c) for c in zip(*ids, strict=True))
        lengths = np.array([len(f) for f in feats])
        mask = np.arange(n) < lengths[:, None]
        tags = np.zeros((len(pairs), n), int)
        for s, (_, y) in enumerate(pairs):
            tags[s, : len(y)] = y
        gold = np.eye(k)[tags] * mask[..., None]
        pair_gold = np.einsum("stk,stl->kl", gold[:, :-1], gold[:, 1:])
        state = [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for _ in range(_SEED_ROUNDS):
            e = np.zeros((len(pairs), n, k))
            np.add.at(e, (seq, pos), self.emit[feat])
            e[:, 0, [i for i, x in enumerate(LABELS) if x[0] == "I"]] -= 1e4
            move = self.move + fixed
            alpha, beta = e.copy(), np.zeros_like(e)
            for t in range(1, n):
                alpha[:, t] = np.where(mask[:, t, None], e[:, t] + _lse(alpha[:, t - 1, :, None] + move), alpha[:, t - 1])
            for t in range(n - 2, -1, -1):
                beta[:, t] = np.where(mask[:, t + 1, None], _lse((move + (e[:, t + 1] + beta[:, t + 1])[:, None, :]).transpose(0, 2, 1)), 0)
            z = _lse(alpha[:, -1, :, None])[:, 0]
            node = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            both = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
            pair = (np.exp(np.minimum(both, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            diff = (gold - node)[seq, pos]
            g_emit = np.zeros_like(self.emit)
            np.add.at(g_emit, feat, diff)
            for w, g, s in ((self.emit, g_emit - _DECAY * self.emit * len(pairs), state[0]), (self.move, pair_gold - pair - _DECAY * self.move * len(pairs), state[1])):
                s += g * g
                w += _RATE * 3 * g / (np.sqrt(s) + 1e-6)
        self.fixed = self.move + fixed
        self.cache: dict[tuple[str, ...], np.ndarray] = {}

    def _scores(self, f: tuple[str, ...]) -> np.ndarray:
        if (got := self.cache.get(f)) is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[f] = sum((self.emit[self.index[x]] for x in f if x in self.index), np.zeros(len(LABELS)))
        return got

    def decode(self, seqs: list[list[re.Match]], limit: int = 100_000) -> list[list[int]]:
        """The best labels of each sequence, by Viterbi over padded batches of sequences of like length, of about ``limit`` tokens."""
        out: list[list[int]] = [[]] * len(seqs)
        order = sorted(range(len(seqs)), key=lambda i: len(seqs[i]))
        start = np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])
        at = 0
        while at < len(order):
            n, own = max(1, len(seqs[order[at]])), []
            while at < len(order) and len(seqs[order[at]]) <= n + n // 4 + 2 and (not own or (len(own) + 1) * n <= limit):
                own.append(order[at])
                at += 1
            n = max(len(seqs[i]) for i in own)
            if not n:
                continue
            lengths = np.array([len(seqs[i]) for i in own])
            e = np.zeros((len(own), n, len(LABELS)))
            for r, i in enumerate(own):
                for t, f in enumerate(_features(seqs[i])):
                    e[r, t] = self._scores(f)
            best, back = e[:, 0] + start, np.zeros((n, len(own), len(LABELS)), np.int8)
            for t in range(1, n):
                step = best[:, :, None] + self.fixed
                back[t] = step.argmax(axis=1)
                best = np.where((t < lengths)[:, None], step.max(axis=1) + e[:, t], best)
            path = np.zeros((len(own), n), int)
            now = best.argmax(axis=1)
            for t in range(n - 1, -1, -1):
                live = t < lengths
                path[live, t] = now[live]
                if t:
                    now = np.where(live, back[t, np.arange(len(own)), now], now)
            for r, i in enumerate(own):
                out[i] = path[r, : lengths[r]].tolist()
        return out


def _lse(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the last axis but one."""
    top = x.max(axis=-2)
    return top + np.log(np.exp(x - top[..., None, :]).sum(axis=-2))


_models: list[WordShapeCRF] = []


def model() -> WordShapeCRF:
    """The field fitted on LABELLED: the same in every process."""
    if not _models:
        _models.append(WordShapeCRF())
    _models[0].cache.clear()
    return _models[0]


def find_spans(texts: list[str], crf: WordShapeCRF) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text. The field's spans that meet a base span are left out."""
    base = [base_spans(t) for t in texts]
    seqs, owner = [], []
    for i, t in enumerate(texts):
        own = sequences(t)
        seqs += own
        owner += [i] * len(own)
    all_spans = [list(b) for b in base]
    for i, seq, tags in zip(owner, seqs, crf.decode(seqs), strict=True):
        at = 0
        while at < len(tags):
            if not tags[at]:
                at += 1
                continue
            kind, end = (tags[at] - 1) // 2, at + 1
            while end < len(tags) and tags[end] == 2 + 2 * kind:
                end += 1
            a, b = seq[at].start(), seq[end - 1].end()
            if not any(x < b and a < y for x, y, _ in base[i]):
                all_spans[i].append((a, b, kind))
            at = end
    return [(b, sorted(s, key=lambda x: (x[0], x[2]))) for b, s in zip(base, all_spans, strict=True)]


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _find(crf: WordShapeCRF):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = find_spans([x or "" for x in part.column("__text").to_pylist()], crf)
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in rows], pa.int64()) for k in range(len(BASE_KINDS))]
            sums = [hashlib.sha256(_join(base).encode()).hexdigest() for base, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array([_join(s) for _, s in rows], pa.string()), pa.array([len(s) for _, s in rows], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_spans"],
            )

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans``.

    Counts and hash are of the base patterns' spans, ``spans`` has these and the field's, as ``kind:start:end`` in code points, by start and then kind; ``n_spans`` is their number.
    The field also finds secrets (keys, tokens and passwords after a word that says so), which have no base pattern.
    Null and empty texts have none; repeated rows each get their row; extra columns are ignored. The
    field is fitted on the driver on LABELLED, in seconds. Whole texts stream by partition.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return map_batches(d, _find(model()), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {counts}, base_sha256 string, spans string, n_spans long")
