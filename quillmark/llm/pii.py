"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds spans.

Base spans are found by rule, per kind, leftmost and non-overlapping; matches that fail their check are dropped.
The field works on the surroundings of digits, '@', '(at)' and '(dot)' in any case, up to blanks. Its segments are single tokens (no entity, score 0)
or candidate spans of at most MOST_TOKENS tokens with a kind, scored by features of the whole span: digit count,
shape of the digit groups, separators, checksum, octets, characters and cue words around. Dynamic programming
chooses boundaries and kinds jointly; spans that do not overlap a base span are added. Its weights are trained here
by conditional log-likelihood (forward and backward over segments) on lines written by a seeded generator.

Defined results: null and empty texts have no spans; repeated rows get equal results; ties between segmentations
go to the one with fewer entities; an empty table gives an empty result; extra columns are ignored. Texts of any
length are read whole; the work grows in proportion to their length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import small_batches, table

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or 0) <= 255


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The base spans, by kind as in KINDS, then start. Each search is linear in the text."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            parts, place = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = place + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append(("ip", place, end))
                place = end + 1
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


_TRIGGER = re.compile(r"[0-9@]|[\[(] ?(?:at|dot) ?[\])]", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s|.", re.S)
_NEAR = 40
_BLANK = re.compile(r"\s")
_NUMERIC = set(" -.()+/")
_OPENERS = set("+(")
_MAILBOX = set("._-+%@()[]")
#: Words that stand before personal data, in the four languages of the corpora at hand.
CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "anruf", "teléfono", "llama", "téléphone", "appel"),
    "card": ("card", "visa", "pay", "karte", "tarjeta", "carte"),
    "ip": ("ip", "host", "server", "address", "adresse", "servidor", "serveur"),
    "email": ("mail", "email", "contact", "kontakt", "correo", "courriel"),
}
_CUE_OF = {w: k for k, ws in CUES.items() for w in ws}


def regions(text: str) -> list[tuple[int, int]]:
    """Maximal stretches near a trigger, extended to the next blank on both sides. No place is looked at twice, so the work is in proportion to the text."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - _NEAR), min(len(text), m.end() + _NEAR)
        low = out[-1][1] if out else 0
        if b <= low:
            continue
        if not text[b - 1].isspace():
            blank = _BLANK.search(text, b)
            b = blank.start() if blank else len(text)
        while a > low and not text[a].isspace() and not text[a - 1].isspace():
            a -= 1
        if out and a <= low:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _class(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./@:#$%()" else "mark"


def candidates(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, str, tuple[str, ...]]]]:
    """Tokens of text[a:b] as (start, end), and (first token, end token, kind, features) of every candidate span."""
    tokens = [m.span() for m in _TOKEN.finditer(text, a, b)]
    words = [text[s:e] for s, e in tokens]
    found = []
    cue = ""
    for i, w in enumerate(words):
        if w.isalpha():
            cue = _CUE_OF.get(w.lower(), "")
        numeric = w[0].isdigit() and w.isascii() or w in _OPENERS
        if numeric and not (i and words[i - 1].isascii() and words[i - 1].isdigit()):
            n = 0
            for j in range(i, min(len(words), i + MOST_TOKENS)):
                x = words[j]
                if x.isascii() and x.isdigit():
                    n += len(x)
                    if n > 19:
                        break
                    if n >= 4:
                        found += _numeric(text, tokens[i][0], tokens[j][1], n, i, j + 1, cue)
                elif x not in _NUMERIC or x == " " and j + 1 < len(words) and words[j + 1] == " ":
                    break
        if w.isalnum() and (not i or words[i - 1] not in _MAILBOX or words[i - 1] in "(["):
            at = False
            for j in range(i, min(len(words), i + MOST_TOKENS)):
                x = words[j]
                if x == "@" or x.lower() == "at" and j and words[j - 1] in "([":
                    at = True
                if x in (" ",) and not (j + 1 < len(words) and words[j + 1] in "([" or words[j - 1] in ")]"):
                    break
                if not (x.isalnum() or x in _MAILBOX or x == " "):
                    break
                if at and x.isalnum() and (j + 1 == len(words) or not words[j + 1].isalnum()):
                    found += _mailbox(text, tokens[i][0], tokens[j][1], i, j + 1, cue)
    return tokens, found


def _around(text: str, s: int, e: int, cue: str, kind: str) -> tuple[str, ...]:
    return (f"before={_class(text[s - 1 : s])}", f"after={_class(text[e : e + 1])}", f"cue={'own' if cue == kind else 'other' if cue else 'none'}")


def _numeric(text, s, e, n, i, j, cue):
    span = text[s:e]
    groups = re.findall("[0-9]+", span)
    shape = "-".join(str(min(len(g), 9)) for g in groups[:6])
    seps = "".join(sorted(set(c for c in span if not c.isdigit())))
    octets = len(groups) == 4 and seps == "." and all(map(_octet, groups))
    common = (f"n={n}", f"shape={shape}", f"seps={seps}", f"open={span[0] if span[0] in _OPENERS else 'digit'}")
    for kind in ("ip", "card", "phone"):
        special = (f"octets={octets}",) if kind == "ip" else (f"luhn={n >= 12 and luhn(_digits(span))}&{16 <= n <= 19}",) if kind == "card" else (f"length={7 <= n <= 15}&{len(groups) > 1}",)
        yield (i, j, kind, tuple(f"{kind}|{f}" for f in ("bias", *common, *special, *_around(text, s, e, cue, kind))))


def _mailbox(text, s, e, i, j, cue):
    span = text[s:e]
    plain = _DOMAIN.fullmatch(span.rpartition("@")[2]) is not None
    spelled = re.fullmatch(r"[\w.+-]+ ?[\[(]at[\])] ?[\w-]+(?: ?(?:[\[(]dot[\])]|\.) ?[\w-]+)+", span, re.I) is not None
    tail = re.search(r"[^\W\d_]+$", span[-5:])
    yield (i, j, "email", tuple(f"email|{f}" for f in ("bias", f"plain={plain}", f"spelled={spelled}", f"ats={min(2, span.count('@'))}", f"tail={min(5, len(tail.group())) if tail else 0}", *_around(text, s, e, cue, "email"))))


class SemiMarkov:
    """Segments: one token of no entity (score 0), or a candidate; `adjacent` scores an entity right behind another."""

    def __init__(self, weights: dict[str, float] | None = None):
        self.w: dict[str, float] = defaultdict(float, weights or {})

    def _scores(self, spans):
        return [sum(self.w.get(f, 0.0) for f in fs) for _, _, _, fs in spans]

    def decode(self, n: int, spans) -> list[int]:
        """Indices of the spans of the best segmentation of n tokens. State 1: the last segment is an entity."""
        best = [[(-math.inf, None, None)] * 2 for _ in range(n + 1)]
        best[0][0] = (0.0, None, None)
        ends = defaultdict(list)
        score, adjacent = self._scores(spans), self.w.get("adjacent", 0.0)
        for k, (i, j, _, _) in enumerate(spans):
            ends[j].append((i, k))
        for t in range(1, n + 1):
            best[t][0] = max(((best[t - 1][s][0], (t - 1, s), None) for s in (0, 1)), key=lambda x: x[0])
            for i, k in ends[t]:
                for s in (0, 1):
                    v = best[i][s][0] + score[k] + adjacent * s
                    if v > best[t][1][0]:
                        best[t][1] = (v, (i, s), k)
        out, at = [], (n, 0 if best[n][0][0] >= best[n][1][0] else 1)
        while at and at[0]:
            _, before, k = best[at[0]][at[1]]
            if k is not None:
                out.append(k)
            at = before
        return out[::-1]

    def expected(self, n: int, spans) -> tuple[list[float], float]:
        """Probability of each span, and expected number of adjacent pairs, by forward and backward sums."""
        def add(a, b):
            return max(a, b) + math.log1p(math.exp(-abs(a - b))) if max(a, b) > -math.inf else -math.inf

        score, adjacent = self._scores(spans), self.w.get("adjacent", 0.0)
        ends, starts = defaultdict(list), defaultdict(list)
        for k, (i, j, _, _) in enumerate(spans):
            ends[j].append((i, k))
            starts[i].append((j, k))
        f = [[-math.inf, -math.inf] for _ in range(n + 1)]
        f[0][0] = 0.0
        for t in range(1, n + 1):
            f[t][0] = add(*f[t - 1])
            for i, k in ends[t]:
                f[t][1] = add(f[t][1], add(f[i][0], f[i][1] + adjacent) + score[k])
        b = [[-math.inf, -math.inf] for _ in range(n + 1)]
        b[n] = [0.0, 0.0]
        for t in range(n - 1, -1, -1):
            go = b[t + 1][0]
            b[t] = [go, go]
            for j, k in starts[t]:
                v = score[k] + b[j][1]
                b[t] = [add(b[t][0], v), add(b[t][1], v + adjacent)]
        z = add(*f[n])
        p = [math.exp(add(f[i][0], f[i][1] + adjacent) + score[k] + b[j][1] - z) for k, (i, j, _, _) in enumerate(spans)]
        pairs = sum(math.exp(f[i][1] + adjacent + score[k] + b[j][1] - z) for k, (i, j, _, _) in enumerate(spans))
        return p, pairs

    def train(self, lines: list[tuple[str, list[Span]]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4) -> None:
        """Gradient steps on the log-likelihood, with a rate per weight that falls with its past gradients."""
        squares: dict[str, float] = defaultdict(float)
        data = []
        for text, gold in lines:
            tokens, spans = candidates(text, 0, len(text))
            where = {(k, tokens[i][0], tokens[j - 1][1]): n for n, (i, j, k, _) in enumerate(spans)}
            right = {where[g] for g in gold if g in where}
            data.append((len(tokens), spans, right))
        for _ in range(epochs):
            for n, spans, right in data:
                if not spans:
                    continue
                p, pairs = self.expected(n, spans)
                grad: dict[str, float] = defaultdict(float)
                grad["adjacent"] -= pairs - sum(1 for x in right for y in right if spans[x][1] == spans[y][0])
                for k, (_, _, _, fs) in enumerate(spans):
                    d = (k in right) - p[k]
                    if abs(d) > 1e-4:
                        for x in fs:
                            grad[x] += d
                for x, d in grad.items():
                    d -= decay * self.w[x]
                    squares[x] += d * d
                    self.w[x] += rate * d / math.sqrt(1e-2 + squares[x])

    def spans(self, text: str) -> list[Span]:
        out = []
        for a, b in regions(text):
            tokens, found = candidates(text, a, b)
            if found:
                out += [(found[k][2], tokens[found[k][0]][0], tokens[found[k][1] - 1][1]) for k in self.decode(len(tokens), found)]
        return out


def training_lines(n: int = 700, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Lines of invented words with personal data in many formats, and with numbers that are none."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice(("ka", "lo", "mer", "ti", "sun", "de", "fra", "po")) for _ in range(rnd.randint(1, 4)))

    def card(sep: str) -> str:
        body = rnd.choice("3456") + num(14)
        d = next(c for c in "0123456789" if luhn(body + c))
        return sep.join((body + d)[i : i + 4] for i in range(0, 16, 4))

    def near_card() -> str:
        c = card("")
        return c[:-1] + str((int(c[-1]) + rnd.randint(1, 9)) % 10)

    octet = lambda: str(rnd.randint(0, 255))
    make = {
        "phone": lambda: rnd.choice((f"+1 ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"+{rnd.randint(20, 99)} {num(3)} {num(6)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+49 {num(2)} {num(7)}", f"0{num(3)}/{num(6)}")),
        "card": lambda: card(rnd.choice(("", " ", "-", "."))),
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "email": lambda: rnd.choice(("{}.{}@{}.{}", "{}{}@{}.{}", "{}.{} (at) {}.{}", "{}.{}[at]{}[dot]{}", "{}_{}(at){}(dot){}")).format(word(), rnd.choice((word(), num(2))), word() + rnd.choice(("", num(1))), rnd.choice(("com", "org", "net", "de", "fr", "es"))),
    }
    none = (lambda: f"20{num(2)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), lambda: f"{num(3)}.{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: num(rnd.randint(1, 6)), near_card, lambda: num(rnd.randint(7, 19)), lambda: f"{rnd.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"@{word()}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"{num(1)} {num(2)} {num(3)} {num(1)}", lambda: f"{num(3)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"1.{num(1)}.{num(2)}.{num(4)}")
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rnd.randint(3, 7)):
            roll = rnd.random()
            if roll < 0.25:
                kind = rnd.choice(KINDS)
                if rnd.random() < 0.4:
                    text += rnd.choice(CUES[kind]) + rnd.choice((" ", ": "))
                span = make[kind]()
                gold.append((kind, len(text), len(text) + len(span)))
                text += span
            elif roll < 0.5:
                if rnd.random() < 0.1:
                    text += rnd.choice(CUES[rnd.choice(KINDS)]) + " "
                text += rnd.choice(none)()
            else:
                text += word()
            text += rnd.choice((" ", " ", ", ", ". ", "\n", " " + word() + " "))
        out.append((text, gold))
    return out


@lru_cache(maxsize=1)
def trained() -> SemiMarkov:
    model = SemiMarkov()
    model.train(training_lines())
    model.w = dict(model.w)
    return model


def find(text: str, model: SemiMarkov) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base and added), each by kind as in KINDS, then start."""
    if not _TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = [x for x in model.spans(text) if not any(s < x[2] and x[1] < e for s, e in taken)] if len(taken) < 64 else _apart(model.spans(text), taken)
    return base, sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))


def _apart(spans: list[Span], taken: list[tuple[int, int]]) -> list[Span]:
    """The spans that overlap none of the many taken ones (sorted by start; those of different kinds may overlap)."""
    from bisect import bisect_left

    starts, reach, far = [s for s, _ in taken], [], 0
    for _, e in taken:
        far = max(far, e)
        reach.append(far)
    return [x for x in spans if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, model: SemiMarkov | None = None) -> DataFrame:
    """doc_id, base and spans: arrays of struct(kind, start, end) in code points, end exclusive."""
    small_batches(docs.sparkSession)
    field = model or trained()
    kind = docs.schema["doc_id"].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            both = [find(t or "", field) for t in b.column(1).to_pylist()]
            cols = [pa.array([[dict(zip(("kind", "start", "end"), x)) for x in r[i]] for r in both], item) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "base", "spans"])

    span = "array<struct<kind: string, start: long, end: long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, base {span}, spans {span}")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* and base_sha256 tell of the base spans, n_added of those that the field adds, spans of all."""
    found = detect(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))
