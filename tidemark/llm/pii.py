"""Personal data: a semi-Markov conditional random field over whole spans, beside fixed base patterns.

Base spans come from fixed patterns, leftmost and non-overlapping a kind. The field then looks at the
stretches of a text that hold digits or an at sign. A stretch is cut into tokens (runs of digits, runs
of letters, single marks); every run of up to ``LONGEST`` tokens is a candidate segment, scored as a
whole (digits, groups, separators, check sum, words before it). Bounded-entity dynamic programming
picks boundaries and kinds together; segments that it adds do not overlap base spans, which all stay.

The field is fitted by its likelihood on stretches whose base spans are known, some of them rewritten
to forms that the base patterns miss (no plus sign, spelled-out at sign, other separators).

Defined cases: a null or empty text has no span; rows that repeat give equal rows; texts of any length
are searched whole for stretches (the field sees the 64 characters before an at sign and 255 after it, 80 after a spelled-out one, at most
three separators between digits, and segments of ``LONGEST`` tokens; base spans have no such limits); spans of a kind never overlap; ties between segmentations go to the one found
first (shorter last segment, then kinds in the order email, ip, card, phone). Positions are code points.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocks import column, slices
from tidemark.llm.samples import share

# Kinds in their order, and base patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns by kind, then start.

    An e-mail address is found from its at sign: the local part is the run of its symbols before
    the sign, back to the end of the last address, which is what a leftmost search gives, without
    its cost on long words.
    """
    out: list[Span] = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


# --- the field -------------------------------------------------------------------------------------------

#: Tokens of a candidate segment at most; rounds and step of the fit; examples that it is fitted on (half of them base spans); documents and places that these come from at most.
LONGEST, ROUNDS, STEP, STRETCHES, FIT_DOCS, FIT_LINES = 24, 12, 0.3, 240, 1500, 4000
#: What a text must hold for any span.
_SOME = r"[0-9@]|[\[(]at[\])]"
#: A segment that the field adds must beat leaving its tokens outside by so many nats.
MARGIN = 2.0
_STRETCH = re.compile(r"[^\s@]{0,64}@[^\s]{1,255}|[\w.%+-]{1,64} ?[\[(]at[\])] ?[\w.\[\]() -]{1,80}|[+(]{0,2}[0-9](?:[0-9]|[ ().+/-]{1,3}(?=[(+0-9]))*+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[\s\S]")
# Words that stand before a span.
_CUES = {"phone": ("tel", "phone", "call", "fax", "mobile", "cell", "ring"), "card": ("card", "visa", "credit", "payment", "amex"), "ip": ("ip", "host", "server", "address", "ping"), "email": ("mail", "email", "contact", "write")}


def _features(kind: str, text: str, before: str, after: str) -> list[str]:
    """Names of the features of a whole segment."""
    digits = _digits(text)
    n = len(digits)
    groups = re.findall(r"[0-9]+", text)
    out = ["one"]
    cue = before[-24:].lower()
    if any(c in cue for c in _CUES[kind]):
        out.append("cue")
    if before[-1:].isalnum() or after[:1].isalnum() or kind == "email" and before[-1:] in _LOCAL:
        out.append("cut")
    if kind == "email":
        local, sign, domain = text.partition("@")
        spelled = re.fullmatch(r"([\w.%+-]+) ?[\[(]at[\])] ?([\w-]+(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]+)+)", text)
        if sign and re.fullmatch(r"[\w.%+-]+", local) and re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", domain):
            out.append("address")
        elif spelled:
            out.append("spelled")
        else:
            out.append("malformed")
        return out
    if kind == "ip":
        parts = text.split(".")
        fits = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
        out.append("quad" if fits else "noquad")
        return out
    if not text[:1] in "+(" and not text[:1].isdigit() or not text[-1:].isdigit():
        out.append("edge")
    if text.count("(") != text.count(")"):
        out.append("brackets")
    if any(c not in "0123456789 ().+-/" for c in text):
        out.append("marks")
    if kind == "card":
        out.append("length" if 13 <= n <= 19 else "wrong")
        out.append("luhn" if n and luhn(digits) else "nocheck")
        if len(groups) > 1 and not all(len(g) == 4 for g in groups[:-1]):
            out.append("uneven")
        if text[:1] == "+":
            out.append("plus")
        return out
    out.append("length" if 9 <= n <= 15 else "wrong")
    out.append("plus" if text[:1] == "+" else "double0" if text.startswith("00") else "noplus")
    if "(" in text:
        out.append("area")
    if len(groups) >= 3 and all(2 <= len(g) <= 4 for g in groups[1:]):
        out.append("grouped")
    if len(groups) == 1:
        out.append("solid")
    if n >= 13 and luhn(digits):
        out.append("luhn")
    if len(text.split(".")) == 4 and text.count(".") == 3 and "-" not in text and " " not in text:
        out.append("quad")
    return out


def _legal(tokens: list[str], i: int, j: int, digits: np.ndarray, sign: np.ndarray) -> tuple[str, ...]:
    """Kinds that a segment can have at all."""
    first, last = tokens[i], tokens[j - 1]
    if not (last.isalnum()):
        return ()
    out = []
    if sign[j] > sign[i] and (first.isalnum() or first in "._%+-"):
        out.append("email")
    n = int(digits[j] - digits[i])
    if first.isdigit() and last.isdigit() and 4 <= n <= 12 and j - i == 7:
        out.append("ip")
    if last.isdigit() and (first.isdigit() or first in "+("):
        if 13 <= n <= 19 and first.isdigit():
            out.append("card")
        if 9 <= n <= 15:
            out.append("phone")
    return tuple(out)


class Stretch:
    """Tokens of a stretch and its candidate segments (start token, end token, kind, features)."""

    def __init__(self, text: str, start: int, end: int) -> None:
        body = text[start:end]
        cuts = [m.start() for m in _TOKEN.finditer(body)] + [len(body)]
        self.tokens = [body[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.cuts = [start + c for c in cuts]
        digits = np.cumsum([0] + [len(t) if t.isdigit() else 0 for t in self.tokens])
        sign = np.cumsum([0] + [t in ("@", "at") for t in self.tokens])
        self.segments: list[tuple[int, int, str, list[str]]] = []
        n = len(self.tokens)
        for j in range(1, n + 1):
            for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
                for kind in _legal(self.tokens, i, j, digits, sign):
                    a, b = self.cuts[i], self.cuts[j]
                    self.segments.append((i, j, kind, [f"{kind}:{f}" for f in _features(kind, text[a:b], text[max(0, a - 24) : a], text[b : b + 1])]))


def _logsum(x: list[float]) -> float:
    top = max(x)
    return top + float(np.log(sum(np.exp(v - top) for v in x)))


class SpanField:
    """Weights of the span features; a token outside every span scores 0."""

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights

    def scores(self, stretch: Stretch) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in s[3]) for s in stretch.segments]

    def decode(self, stretch: Stretch) -> list[tuple[int, int, str]]:
        """Best segmentation: at each token, the best of leaving it outside or ending a segment there."""
        n = len(stretch.tokens)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(stretch.segments):
            by_end[s[1]].append(k)
        score = self.scores(stretch)
        for j in range(1, n + 1):
            best[j] = best[j - 1]
            for k in by_end[j]:
                value = best[stretch.segments[k][0]] + score[k] - MARGIN
                if value > best[j]:
                    best[j], back[j] = value, k
        out, j = [], n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, e, kind, _ = stretch.segments[back[j]]
                out.append((stretch.cuts[i], stretch.cuts[e], kind))
                j = i
        return out[::-1]

    def gradient(self, stretch: Stretch, gold: set[tuple[int, int, str]]) -> dict[str, float]:
        """Features of the known segmentation less their expectation, by the forward-backward recursions over segments."""
        n, score = len(stretch.tokens), self.scores(stretch)
        ahead: list[list[float]] = [[] for _ in range(n + 1)]
        alpha = [0.0] * (n + 1)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for k, s in enumerate(stretch.segments):
            by_end[s[1]].append(k)
            by_start[s[0]].append(k)
        for j in range(1, n + 1):
            alpha[j] = _logsum([alpha[j - 1], *(alpha[stretch.segments[k][0]] + score[k] for k in by_end[j])])
        beta = [0.0] * (n + 1)
        for i in range(n - 1, -1, -1):
            beta[i] = _logsum([beta[i + 1], *(beta[stretch.segments[k][1]] + score[k] for k in by_start[i])])
        out: dict[str, float] = {}
        for k, (i, j, kind, names) in enumerate(stretch.segments):
            p = float(np.exp(alpha[i] + score[k] + beta[j] - alpha[n]))
            d = ((stretch.cuts[i], stretch.cuts[j], kind) in gold) - p
            if abs(d) > 1e-9:
                for f in names:
                    out[f] = out.get(f, 0.0) + d
        return out

    @classmethod
    def fit(cls, examples: list[tuple[str, list[Span]]]) -> SpanField:
        """Adagrad on the log-likelihood of the known segmentations."""
        ready = []
        for text, spans in examples:
            gold = {(s, e, k) for k, s, e in spans}
            ready += [(stretch, gold) for stretch in stretches(text)]
        weights: dict[str, float] = {}
        seen: dict[str, float] = {}
        field = cls(weights)
        for _ in range(ROUNDS):
            for stretch, gold in ready:
                for f, g in field.gradient(stretch, gold).items():
                    seen[f] = seen.get(f, 0.0) + g * g
                    weights[f] = weights.get(f, 0.0) * (1 - 1e-4) + STEP * g / (seen[f] ** 0.5 + 1e-6)
        return field


def stretches(text: str) -> Iterator[Stretch]:
    for m in _STRETCH.finditer(text):
        if "@" in m.group() or "at" in m.group() or len(_digits(m.group())) >= 7:
            yield Stretch(text, m.start(), m.end())


def _rewrite(kind: str, value: str, pick: random.Random) -> str:
    """A form of a known value that the base patterns may miss."""
    if kind == "phone":
        return pick.choice([value, value.lstrip("+"), "00" + value.lstrip("+"), re.sub(r"^\+[0-9]+ ", "", value), value.replace("-", "/"), value.replace(" ", "-")])
    if kind == "email":
        local, _, domain = value.partition("@")
        return pick.choice([value, f"{local} (at) {domain}", f"{local}[at]{domain.replace('.', '[dot]')}"])
    if kind == "card":
        d = _digits(value)
        return pick.choice([value, ".".join(d[i : i + 4] for i in range(0, len(d), 4))])
    return value


def _made_up(pick: random.Random) -> tuple[str, str | None]:
    """A value made by rule, and its kind; kind None is a number that is no personal data."""
    run = lambda n: "".join(pick.choice("0123456789") for _ in range(n))
    what = pick.randrange(8)
    if what == 0:
        name = lambda low, high: "".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(pick.randrange(low, high)))
        local = pick.choice([name(2, 12), f"{name(2, 8)}.{name(2, 10)}", f"{name(1, 2)}_{name(3, 9)}{run(pick.randrange(0, 4))}"])
        return f"{local}@{'.'.join(name(2, 10) for _ in range(pick.randrange(1, 3)))}.{name(2, 5)}", "email"
    if what == 1:
        return ".".join(str(pick.randrange(256)) for _ in range(4)), "ip"
    if what == 2:
        body = run(15)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        return pick.choice([full, " ".join(full[i : i + 4] for i in range(0, 16, 4)), "-".join(full[i : i + 4] for i in range(0, 16, 4))]), "card"
    if what == 3:
        return f"+{pick.choice(['1', '44', '49', '33'])} ({run(3)}) {run(3)}-{run(4)}", "phone"
    if what == 4:
        body = run(16)
        return (body if not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)), None
    if what == 5:
        return f"{run(4)}-{run(2)}-{run(2)} {run(2)}.{run(2)}", None
    if what == 6:
        return ".".join(str(300 + pick.randrange(600)) for _ in range(4)), None
    return f"{run(8)}", None


def fit_spans(docs: DataFrame, most_docs: int = FIT_DOCS, most_lines: int = FIT_LINES, seed: int = 7) -> SpanField:
    """Fits on base spans in a bounded sample of documents (by a hash of the id) and, of these, of places with digits or an at sign (by a hash of id and place), and on values made by rule."""
    total = docs.count()
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (share("doc_id") < F.lit(min(1.0, most_docs / max(total, 1)))))
    around = F.regexp_extract_all(F.col("text"), F.lit(r".{0,30}[0-9+@].{0,60}"), F.lit(0))
    places = rows.select("doc_id", F.posexplode(around).alias("at", "line")).withColumn("h", F.xxhash64("doc_id", "at"))
    pick = random.Random(seed)
    lines = [r.line for r in places.orderBy("h", "doc_id", "at", "line").limit(most_lines).collect()]
    examples: list[tuple[str, list[Span]]] = []
    for line in lines:
        spans = base_spans(line)
        if spans and len(examples) < STRETCHES // 2:
            examples.append((line, spans))
            kind, s, e = spans[0]
            other = _rewrite(kind, line[s:e], pick)
            if len(spans) == 1 and other != line[s:e]:
                examples.append((line[:s] + other + line[e:], [(kind, s, s + len(other))]))
    while len(examples) < STRETCHES:
        value, kind = _made_up(pick)
        other = _rewrite(kind, value, pick) if kind else value
        lead = pick.choice(["see ", "on the ", "", "number "])
        examples.append((f"{lead}{other} and so on", [(kind, len(lead), len(lead) + len(other))] if kind else []))
    return SpanField.fit(examples)


def find_spans(text: str, field: SpanField) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those that the field adds."""
    base = base_spans(text)
    added: list[Span] = []
    if "@" in text or "at" in text or _DIGIT.search(text):
        taken = sorted((s, e) for _, s, e in base)
        for stretch in stretches(text):
            if stretch.segments:
                added += [(kind, s, e) for s, e, kind in field.decode(stretch) if not any(s < y and x < e for x, y in taken)]
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted(base + added, key=lambda s: (rank[s[0]], s[1], s[2]))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans give one mask."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


@lru_cache(maxsize=1)
def _fields() -> dict:
    return {**{f"n_{k}": pa.int64() for k in KINDS}, "base_sha256": pa.string(), "spans": pa.string(), "n_added": pa.int64(), "masked": pa.string()}


def detect_pii(docs: DataFrame, field: SpanField, carry: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", masked: bool = False) -> DataFrame:
    """Counts and digest of the base spans and all spans of each text; one pass, no shuffle.

    With ``masked`` the text with all spans masked comes as well (null for a null text). A carried column whose name
    is the name of a result comes back as ``carried_`` and its name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    own = [id_col, *carry]
    names = [k for k in _fields() if masked or k != "masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, "t"):
            rows: dict[str, list] = {k: [] for k in names}
            some = pc.match_substring_regex(column(batch, "t"), _SOME).to_pylist()
            for text, search in zip(column(batch, "t").to_pylist(), some, strict=True):
                base, every = find_spans(text, model) if search else ([], [])
                for k in KINDS:
                    rows[f"n_{k}"].append(sum(s[0] == k for s in base))
                rows["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                rows["spans"].append(join_spans(every))
                rows["n_added"].append(len(every) - len(base))
                if masked:
                    rows["masked"].append(text if text is None or not every else mask(text, every))
            yield pa.RecordBatch.from_arrays([*(column(batch, f"c{i}") for i in range(len(own))), *(pa.array(rows[k], _fields()[k]) for k in names)], [*(f"c{i}" for i in range(len(own))), *names])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    narrow = docs.selectExpr(*(f"`{c}` AS c{i}" for i, c in enumerate(own)), f"cast(`{text_col}` AS string) AS t")
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(own)), *(f"{k} {'string' if _fields()[k] == pa.string() else 'long'}" for k in names)])
    out = narrow.mapInArrow(run, schema)
    return out.select(*(F.col(f"c{i}").alias(f"carried_{c}" if c in names else c) for i, c in enumerate(own)), *names)
