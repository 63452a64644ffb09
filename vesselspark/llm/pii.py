"""Personal data by candidate gradient boosting.

Base spans follow fixed patterns and always stay. High-recall generators propose further spans, which may overlap:
rewritten addresses, numbers with other separators, runs of groups inside longer numbers. Boosted trees score each
candidate by its format and context, and per-kind thresholds, calibrated on held-out documents, select what is added; no
rule stands before them. The trees learn from the base spans of all documents, these spans in rewritten forms and contexts,
and candidates that a format rule refutes; other candidates pass such a rule and may be real, so they have no label.
Spark counts equal training rows, and every cut, gradient and precision is of these counts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.common import map_texts
from vesselspark.tables import drop_table, scratch, write_table

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A digit run that starts no address is stepped over whole: none of its tails can start one either.
DOTTED = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Trees grow in the driver on the counts of up to so many different training rows, on Spark's executors beyond.
LOCAL_ROWS = 50_000
#: Different training rows that a task counts before it passes them on.
COUNTED_ROWS = 5000


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def _valid(kind: int, text: str) -> bool:
    """The base rule on a match of the base pattern."""
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))
    n = len(only_digits(text))
    return kind == 0 or (12 <= n <= 19 and luhn(only_digits(text)) if kind == 2 else 9 <= n <= 15)


def matches(text: str) -> list[Span]:
    """All matches of the base patterns, leftmost and non-overlapping per kind, whether they pass their rule or not."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append((start, 0, last))
        at = text.find("@", at + 1)
    if HAS_DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in DOTTED.finditer(text) if "." in m[0]]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text)]
    return found


def base_spans(text: str) -> list[Span]:
    return sorted(s for s in matches(text) if _valid(s[1], text[s[0] : s[2]]))


HAS_DIGIT = re.compile("[0-9]")
AT, DOT = r"\s?(?:\(at\)|\[at\]|\{at\}|<at>|@|\sat\s)\s?", r"\s?(?:\(dot\)|\[dot\]|\{dot\}|\.|\sdot\s)\s?"
WIDE_EMAIL = re.compile(rf"[\w.%+-]{{1,64}}{AT}[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{1,6}}", re.I)
#: An address at the start of a candidate: a plain dot joins its words, and it ends in letters.
ADDRESS = re.compile(rf"[\w.%+-]{{1,64}}{AT}(?:[\w-]{{1,63}}(?:\s?(?:\(dot\)|\[dot\]|\{{dot\}})\s?|\.|\sdot\s)){{1,6}}[^\W\d_]{{2,24}}(?!\w)", re.I)
#: The middle of each AT, and what may stand before it.
AT_SIGN = re.compile(r"\(at\)|\[at\]|\{at\}|<at>|@|(?<=\s)at(?=\s)", re.I)
BEFORE_AT = re.compile(r"[\w.%+-]{1,64}\s{0,2}\Z")
#: A row of groups of any length; each group is taken whole, so a row is read once.
GROUPS = re.compile(r"(?<![\w+])[+(]{0,2}\d++(?:[ ().\-/]{1,3}+\d++)+(?!\w)")
RUN = re.compile(r"(?<![\w.])\d{9,19}(?![\w])")
SIX = re.compile(r"(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])", re.I)
# Words that announce a datum, by kind, and words that announce other numbers.
CUE_WORDS = (
    ("mail", "e-mail", "email", "contact", "write", "kontakt", "schreib", "courriel", "correo", "escribe"),
    ("ip", "host", "address", "server", "adresse", "serveur", "servidor"),
    ("card", "visa", "credit", "payment", "karte", "kreditkarte", "carte", "tarjeta", "mastercard"),
    ("phone", "call", "tel", "mobile", "fax", "number", "telefon", "handy", "anruf", "nummer", "téléphone", "appel", "numéro", "teléfono", "móvil", "llama", "número"),
)
OTHER_WORDS = ("order", "invoice", "ref", "serial", "part", "version", "isbn", "item", "tracking", "bestellung", "rechnung", "commande", "facture", "pedido", "factura", "page", "room", "row", "date", "account")
CUES = re.compile("|".join(rf"(\b(?:{'|'.join(words)}))" for words in (*CUE_WORDS, OTHER_WORDS)), re.I)
BEFORE = 24  # characters that a cue is looked for in
#: Cues that training puts before forms; the others are known to be such words, but are met in real text only.
TAUGHT = (("mail", "contact", "kontakt"), ("ip", "host"), ("card", "karte"), ("call", "tel", "telefon", "number"))
TAUGHT_OTHER = ("order", "invoice", "ref", "part", "bestellung")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data; they may overlap. Linear in the text: addresses are bounded and tried around each
    at, and of a row of number groups, however long, any six in turn are combined."""
    found: set[Span] = set()
    for at in AT_SIGN.finditer(text):
        low = max(0, at.start() - 66)
        if (own := BEFORE_AT.search(text[low : at.start()])) and (m := WIDE_EMAIL.match(text, low + own.start())):
            found.add((m.start(), 0, m.end()))
    if HAS_DIGIT.search(text):
        for m in GROUPS.finditer(text):
            groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", m[0])]
            for i in range(len(groups)):
                for j in range(i + 1, min(len(groups), i + 6)):
                    start, end = m.start() + groups[i][0], m.start() + groups[j][1]
                    n = len(only_digits(text[start:end]))
                    if j == i + 3 and re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", text[start:end]):
                        found.add((start, 1, end))
                    if 12 <= n <= 19:
                        found.add((start, 2, end))
                    if 9 <= n <= 15:
                        opened = start - m.start()
                        while opened and m[0][opened - 1] in "+(":
                            opened -= 1
                        found.add((m.start() + opened, 3, end))
        for m in RUN.finditer(text):
            found |= {(m.start(), kind, m.end()) for kind, low, high in ((2, 12, 19), (3, 9, 15)) if low <= len(m[0]) <= high}
        if ":" in text:
            found |= {(m.start(), 1, m.end()) for m in SIX.finditer(text)}
    return sorted(found)


def apart(proposed: list[Span], base: list[Span]) -> list[Span]:
    """The proposed spans that overlap none of the base spans, which are sorted."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    return [c for c in proposed if not (k := bisect_left(starts, c[2])) or ends[k - 1] <= c[0]]


def cued(text: str, span: Span) -> tuple[bool, bool, bool]:
    """Whether a cue of the candidate's kind, of another kind, and of other numbers stands before it."""
    start, kind, _ = span
    groups = {m.lastindex - 1 for m in CUES.finditer(text, max(0, start - BEFORE), start)}
    return kind in groups, bool(groups & (set(range(len(KINDS))) - {kind})), len(KINDS) in groups


def plausible(text: str, span: Span) -> bool:
    """Whether a candidate passes its format rule: an address without blanks at plain dots, an IP address, a check digit, or
    a number of a phone's length after a word for one or with its opening sign."""
    start, kind, end = span
    body = text[start:end]
    if kind == 0:
        return bool(ADDRESS.match(body))
    if kind == 1:
        return ":" in body or _valid(1, body)
    if kind == 2:
        return _valid(2, body)
    own, _, other = cued(text, span)
    return _valid(3, body) and not other and (body[0] in "+(" or own)


SEPARATED = re.compile(r"(?<=\d)[ ().\-/]+(?=\d)")
AT_WORD, DOT_WORD = re.compile(r"\sat\s", re.I), re.compile(r"\sdot\s", re.I)
IN_BRACKETS = re.compile(r"[(\[{<](at|dot)[)\]}>]", re.I)


def describe(text: str, span: Span) -> list[float]:
    """Format and context of a candidate as numbers."""
    start, kind, end = span
    body, before, after = text[start:end], text[max(0, start - 1) : start], text[end : end + 1]
    digits = only_digits(body)
    groups = [len(g) for g in re.findall(r"\d+", body)]
    parts = re.split(DOT, body, flags=re.I) if kind == 0 else [body]
    own, another, other = cued(text, span)
    separators = set(SEPARATED.findall(body))
    return [
        float(kind), float(kind == 0) * len(body), float(len(digits)), float(sum(map(str.isalpha, body))), float(len(groups)),
        float(max(groups, default=0)), float(min(groups, default=0)), float(len(set(digits))),
        float(kind == 2 and luhn(digits or "1")), float(body.startswith("+")), float("(" in body), float("@" in body),
        float(bool(IN_BRACKETS.search(body))), float(len(parts[-1]) if kind == 0 else 0), float(parts[-1].isalpha()),
        float(kind == 1 and (":" in body or all(int(g) <= 255 for g in re.findall(r"\d+", body)))),
        float(bool(before) and not before.isspace()), float(bool(after) and not (after.isspace() or after in ".,;")),
        float(own), float(another), float(other), float(digits[:1] == "0"), float(groups == [4, 4, 4, 4]), float(len(separators)),
        float(kind == 0 and bool(ADDRESS.match(body))), float(kind == 0 and bool(AT_WORD.search(body))), float(kind == 0 and bool(DOT_WORD.search(body))),
        float(kind == 0 and ". " in body), float(kind == 2 and 12 <= len(digits) <= 19), float(kind == 3 and 9 <= len(digits) <= 15),
        float(kind == 3 and body[:1] in ("+", "(")), float(groups[:1] == [4] and digits[:2] in ("19", "20")),
    ]


QUANTILES = np.linspace(0, 1, 32)
BINS = len(QUANTILES)
Cuts = list[np.ndarray]  # by feature


def leaves(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The node of the tree in which each row ends."""
    at = np.zeros(len(x), dtype=int)
    while True:
        inner = np.flatnonzero(tree[at, 0] >= 0)
        if not len(inner):
            return at
        node = tree[at[inner]]
        low = x[inner, node[:, 0].astype(int)] <= node[:, 1]
        at[inner] = np.where(low, node[:, 2], node[:, 3]).astype(int)


def node_sums(x: np.ndarray, n: np.ndarray, good: np.ndarray, score: np.ndarray, tree: np.ndarray, cuts: Cuts) -> np.ndarray:
    """Per leaf, feature and bin between cuts, flat: slope and curve of the loss, and the rows, of which ``x`` stands for
    ``n`` each, ``good`` of them labelled 1. Slopes are rounded to a binary fraction, so that their sums are exact in any
    order, up to 2**29 rows."""
    p = 1 / (1 + np.exp(-score))
    bins = np.column_stack([np.searchsorted(at, x[:, k], side="left") for k, at in enumerate(cuts)])
    slot = ((leaves(tree, x)[:, None] * len(cuts) + np.arange(len(cuts))) * BINS + bins).ravel()
    fixed = [np.round(v * 2.0**24) / 2.0**24 for v in (n * p - good, n * p * (1 - p), n)]
    return np.stack([np.bincount(slot, np.repeat(v, len(cuts)), len(tree) * len(cuts) * BINS) for v in fixed])


class Rows(Protocol):
    """Training rows and the score that the trees so far give them."""

    def totals(self) -> tuple[float, float]:
        """How many rows, and how many of label 1."""

    def begin(self, prior: float) -> None: ...

    def sums(self, tree: np.ndarray, cuts: Cuts) -> np.ndarray: ...

    def add(self, tree: np.ndarray) -> None: ...


class LocalRows:
    def __init__(self, x: np.ndarray, n: np.ndarray, good: np.ndarray):
        self.x, self.n, self.good, self.score = x, n, good, np.zeros(len(n))

    def totals(self) -> tuple[float, float]:
        return float(self.n.sum()), float(self.good.sum())

    def begin(self, prior: float) -> None:
        self.score = np.full(len(self.n), prior)

    def sums(self, tree: np.ndarray, cuts: Cuts) -> np.ndarray:
        return node_sums(self.x, self.n, self.good, self.score, tree, cuts)

    def add(self, tree: np.ndarray) -> None:
        self.score = self.score + tree[leaves(tree, self.x), 1]


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class TableRows:
    """The same of a table (x, n, good) in Spark: a job a level of a tree, whose sums per leaf and bin are all that the
    driver gets, and a rewritten table of scores a tree."""

    def __init__(self, table: DataFrame):
        self.table, self.written = table.select("x", "n", "good"), None

    def totals(self) -> tuple[float, float]:
        return tuple(self.table.agg(F.sum("n").cast("double"), F.sum("good").cast("double")).first())

    def _write(self, df: DataFrame) -> None:
        following = write_table(df)
        if self.written is not None:
            drop_table(self.written)
        self.written = following

    def begin(self, prior: float) -> None:
        self._write(self.table.withColumn("score", F.lit(prior)))

    def sums(self, tree: np.ndarray, cuts: Cuts) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                n, good, score = (batch.column(k).to_numpy().astype(float) for k in (1, 2, 3))
                got = node_sums(matrix(batch.column(0)), n, good, score, tree, cuts)
                (slot,) = np.nonzero(got[2])
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), *(pa.array(v[slot]) for v in got)], ["slot", "slope", "curve", "n"])

        parts = self.written.mapInArrow(run, "slot int, slope double, curve double, n double").groupBy("slot")
        found = parts.agg(*(F.sum(c).alias(c) for c in ("slope", "curve", "n"))).collect()  # leaves x features x bins
        total = np.zeros((3, len(tree) * len(cuts) * BINS))
        for r in found:
            total[:, r.slot] = r.slope, r.curve, r.n
        return total

    def add(self, tree: np.ndarray) -> None:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in filter(len, batches):
                score = batch.column(3).to_numpy() + tree[leaves(tree, matrix(batch.column(0))), 1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], batch.schema.names)

        self._write(self.written.mapInArrow(run, self.written.schema))


@dataclass
class Trees:
    """Boosted regression trees on the log-odds. A tree: per node (feature, cut, left, right), leaves (-1, value, 0, 0)."""

    prior: float = 0.0
    trees: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 4) -> Trees:
        cuts = [np.unique(np.quantile(x[:, k], QUANTILES))[:-1] for k in range(x.shape[1])]
        return self.grow(LocalRows(x, np.ones(len(y)), y), cuts, rounds, rate, depth)

    def grow(self, rows: Rows, cuts: Cuts, rounds: int = 60, rate: float = 0.2, depth: int = 4) -> Trees:
        n, good = rows.totals()
        rate_1 = np.clip(good / n, 1e-3, 1 - 1e-3)
        self.prior = float(np.log(rate_1 / (1 - rate_1)))
        rows.begin(self.prior)
        for _ in range(rounds):
            tree = self._tree(rows, cuts, rate, depth)
            self.trees.append(tree)
            rows.add(tree)
        return self

    @staticmethod
    def _tree(rows: Rows, cuts: Cuts, rate: float, depth: int) -> np.ndarray:
        """A tree grown level by level: each leaf of 8 rows or more is split where the gain is largest, if any is."""
        nodes, open_nodes = [[-1, 0.0, 0, 0]], [0]
        is_cut = np.arange(BINS - 1) < np.array([len(at) for at in cuts])[:, None]
        for level in range(depth):
            sums = rows.sums(np.array(nodes), cuts).reshape(3, len(nodes), len(cuts), BINS)
            following: list[int] = []
            for own in open_nodes:
                g, h, n = sums[:, own, 0].sum(axis=1)
                if level == 0:
                    nodes[own][1] = -rate * g / (h + 1)
                left_g, left_h = np.cumsum(sums[:2, own], axis=2)[:, :, :-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                k, top = np.unravel_index(np.argmax(np.where(is_cut, gain, -np.inf)), gain.shape)
                if n < 8 or not is_cut[k, top] or gain[k, top] <= 1e-6:
                    continue
                a, b = left_g[k, top], left_h[k, top]
                following += [len(nodes), len(nodes) + 1]
                nodes[own] = [k, cuts[k][top], len(nodes), len(nodes) + 1]
                nodes += [[-1, -rate * a / (b + 1), 0, 0], [-1, -rate * (g - a) / (h - b + 1), 0, 0]]
            open_nodes = following
            if not open_nodes:
                break
        return np.array(nodes)

    def margin(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.prior)
        for tree in self.trees:
            score += tree[leaves(tree, x), 1]
        return score

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


@dataclass
class PiiModel:
    trees: Trees
    thresholds: list[float]


def grouped_digits(digits: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for size in sizes:
        out.append(digits[at : at + size])
        at += size
    return sep.join(out)


def rewritten(kind: int, body: str) -> list[str]:
    """A base span in forms that the base patterns miss."""
    if kind == 0:
        name, _, domain = body.partition("@")
        short = ".".join(domain.split(".")[-2:])
        forms = [f"{name} (at) {domain.replace('.', ' (dot) ')}", f"{name}[at]{domain}", f"{name} at {domain.replace('.', ' dot ')}"]
        return forms + [f"{name} at {short.replace('.', ' dot ')}", f"{name} [at] {short.replace('.', ' [dot] ')}", f"{name}@{short.replace('.', '(dot)')}"]
    digits = only_digits(body)
    if kind == 2 and len(digits) == 16:
        return [grouped_digits(digits, (4, 4, 4, 4), sep) for sep in (".", " ", "-", "/")]
    if kind == 1:
        hexes = hashlib.sha256(body.encode()).hexdigest()
        parts = [hexes[k : k + 4] for k in range(0, 32, 4)]
        return [":".join(parts), ":".join(["2001", "db8", "0", "0", "0", *(p.lstrip("0") or "0" for p in parts[5:])])]
    if kind == 3:
        national = ("0" + digits * 2)[:11]
        forms = [grouped_digits(national, sizes, sep) for sizes, sep in (((3, 3, 3), " "), ((3, 3, 3), "-"), ((2, 2, 2, 2, 2), " "), ((4, 3, 3), " "), ((4, 6), "/"), ((3, 3, 4), "."))]
        return forms + [f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}"] if len(digits) >= 10 else forms
    return []


def refuted(kind: int, body: str) -> list[str]:
    """Forms of a base span that are no such datum any more: a wrong check digit, a part above 255, a grouping that
    dates and times have, the end of a sentence."""
    digits = only_digits(body)
    if kind == 0:
        name, _, domain = body.partition("@")
        first, _, second = domain.partition(".")
        return [f"{name} at {first}. {second.partition('.')[0].capitalize()}"]
    if kind == 2:
        dated = f"{digits[:4]}-{digits[4:6]}-{digits[6:8]} {digits[8:10]} {digits[10:12]}"
        broken = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        return [body[:-1] + broken[-1], dated, *(grouped_digits(broken, (4, 4, 4, 4), sep) for sep in (".", " ") if len(digits) == 16)]
    if kind == 1:
        return [f"{int(p) + 256}.{rest}" for p, _, rest in [body.partition(".")]]
    if kind == 3 and len(digits) >= 10:
        return [f"{digits[:4]}-{digits[4:6]}-{digits[6:8]} {digits[8:10]}", f"20{digits[:2]}-{digits[2:4]}-{digits[4:6]} {digits[6:8]} {digits[8:10]}"]
    return []


def training_rows(text: str) -> Iterator[list[float]]:
    """Labelled candidates of one text: features, then 1 or 0. Base spans are data, as are their rewritten forms; these
    stand once where the span stood and once after a word that announces them. A number in the form of a phone's is one
    after such a word or with its opening sign, but never after a word for other numbers. Of the text's own candidates
    those that fail their format rule are none; others pass it and may be real, so they have no label."""
    base = base_spans(text)
    for start, kind, end in base:
        yield [*describe(text, (start, kind, end)), 1.0]
        choice = hashlib.sha256(text[start:end].encode()).digest()
        left, right = text[max(0, start - 60) : start], text[end : end + 60]
        cue, other = TAUGHT[kind][choice[0] % len(TAUGHT[kind])], TAUGHT_OTHER[choice[1] % len(TAUGHT_OTHER)]
        places = [(left, None), (f"{left[-30:]} {cue} ", 1.0)] + ([(f"{left[-30:]} {other} ", 0.0), (f"{left[-30:]} {other} number ", 0.0)] if kind == 3 else [])
        for form in rewritten(kind, text[start:end]):
            for before, label in places:
                changed, own = before + form + right, (len(before), kind, len(before) + len(form))
                yield [*describe(changed, own), label if label is not None else float(kind != 3 or plausible(changed, own))]
                yield from ([*describe(changed, c), 0.0] for c in candidates(changed) if own[0] <= c[0] and c[2] <= own[2] and c[1:] != own[1:])
        for form in refuted(kind, text[start:end]):
            for before, _ in places[:2]:
                yield [*describe(before + form + right, (len(before), kind, len(before) + len(form))), 0.0]
    yield from ([*describe(text, c), 0.0] for c in apart(candidates(text), base) if not plausible(text, c))


def counted_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The training rows of all documents, equal ones counted: ``(held, x, n, good)``, where ``good`` of ``n`` rows with the
    features ``x`` have label 1. A quarter of the different texts, by hash, is held out of growing trees."""
    text = F.col(text_col)
    texts = docs.where(text.rlike("[0-9@]")).select((F.pmod(F.xxhash64(text), F.lit(4)) == 3).alias("held"), text.alias("text"))

    def counted(held: bool, seen: Counter) -> pa.RecordBatch:
        rows = np.array(list(seen))
        x = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] - 1), rows[:, :-1].ravel())
        n = np.fromiter(seen.values(), np.int64, len(seen))
        return pa.RecordBatch.from_arrays([pa.array([held] * len(n)), x, pa.array(n), pa.array(n * (rows[:, -1] > 0))], ["held", "x", "n", "good"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter] = {False: Counter(), True: Counter()}
        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = seen[held]
                for row in training_rows(text):
                    own[tuple(row)] += 1
                    if len(own) >= COUNTED_ROWS:
                        yield counted(held, own)
                        own.clear()
        yield from (counted(held, own) for held, own in seen.items() if own)

    parts = texts.mapInArrow(run, "held boolean, x array<double>, n long, good long")
    return parts.groupBy("held", "x").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def quantile_cuts(rows: DataFrame, width: int) -> Cuts:
    """Per feature the different 32nds of all rows. A feature is a length, a count or a flag, so its different values,
    which the exact percentile keeps, grow with the root of the characters at most."""
    at = F.array(*(F.lit(float(q)) for q in QUANTILES))
    found = rows.agg(*(F.percentile(F.col("x")[k], at, F.col("n")).alias(f"x{k}") for k in range(width))).first()
    return [np.unique(v)[:-1] for v in found]


def train(docs: DataFrame, text_col: str = "text", local_rows: int = LOCAL_ROWS) -> PiiModel:
    """Fit on every candidate with a label of all documents. Three quarters of the texts grow the trees, the rest sets the
    thresholds. Up to ``local_rows`` different training rows, with their counts, are added up in the driver, more where
    they lie; the trees are the same."""
    with scratch():
        rows = write_table(counted_rows(docs, text_col))
        growing = rows.where("not held")
        first = growing.select("x").first()
        if first is None:
            return PiiModel(Trees(), [2.0] * len(KINDS))
        cuts = quantile_cuts(growing, len(first.x))
        if growing.count() <= local_rows:
            got = growing.select("x", "n", "good").toArrow().combine_chunks()
            x, n, good = matrix(got.column(0).combine_chunks()), *(got.column(k).to_numpy().astype(float) for k in (1, 2))
            trees = Trees().grow(LocalRows(x, n, good), cuts)
        else:
            trees = Trees().grow(TableRows(growing), cuts)
        return PiiModel(trees, thresholds(rows.where("held"), trees))


STEPS = 64  # of thresholds in one unit of log-odds
MOST = 40  # log-odds; beyond them a probability is 1


def thresholds(rows: DataFrame, trees: Trees) -> list[float]:
    """By kind, calibrated on all rows of ``(x, n, good)``, which are counted by their log-odds in steps."""
    fixed = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            x = matrix(batch.column(0))
            step = np.floor(np.clip(fixed.value.margin(x), -MOST, MOST) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(step), *batch.columns[1:]], ["kind", "step", "n", "good"])

    steps = rows.select("x", "n", "good").mapInArrow(run, "kind int, step int, n long, good long").groupBy("kind", "step")
    found = steps.agg(F.sum("n"), F.sum("good")).collect()  # at most 2 * MOST * STEPS + 1 a kind
    made = []
    for kind in range(len(KINDS)):
        step, n, good = (np.array([r[k] for r in found if r.kind == kind], dtype=float) for k in (1, 2, 3))
        low, high = (1 / (1 + np.exp(-(step + up) / STEPS)) for up in (0, 1))
        made.append(calibrate(low, good, count=n, upper=high))
    return made


def calibrate(score: np.ndarray, label: np.ndarray, precision: float = 0.995, least: float = 0.95, count: np.ndarray | None = None, upper: np.ndarray | None = None) -> float:
    """A threshold of ``least`` or more at which the selected held-out rows have the precision: halfway between the
    last row selected and the first one left out. 2, which nothing reaches, if there is none. An entry may stand for
    ``count`` rows, ``label`` of them right, with scores from ``score`` to below ``upper``."""
    order = np.argsort(-score, kind="stable")
    upper = (score if upper is None else upper)[order]
    score, right = score[order], np.cumsum(label[order]) / np.cumsum(np.ones(len(order)) if count is None else count[order])
    fine = np.flatnonzero((right >= precision) & (score >= least))
    if not len(fine):
        return 2.0
    below = upper[fine[-1] + 1] if fine[-1] + 1 < len(score) else 0.0
    return max(least, float(score[fine[-1]] + below) / 2)


def spans(text: str, model: PiiModel) -> tuple[list[Span], list[Span]]:
    """(base, all): base spans, and these with the selected candidates, surest first, that overlap none chosen before; of
    equally sure ones the first in the text, of these the longest. The trees decide on every candidate."""
    base = base_spans(text)
    proposed = sorted(apart(candidates(text), base), key=lambda s: (s[0], -s[2], s[1]))
    if not proposed or not model.trees.trees:
        return base, base
    chosen: list[Span] = []  # in order, none overlapping another
    sure = model.trees.predict(np.array([describe(text, c) for c in proposed]))
    for k in np.argsort(-sure, kind="stable"):
        start, kind, end = proposed[k]
        if sure[k] < model.thresholds[kind]:
            continue
        at = bisect_left(chosen, (start,))
        if (not at or chosen[at - 1][2] <= start) and (at == len(chosen) or chosen[at][0] >= end):
            chosen.insert(at, (start, kind, end))
    return base, sorted([*base, *chosen])


def joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(found))


def redacted(text: str, found: list[Span]) -> str:
    """The text with its spans replaced by their kind in brackets; overlapping ones as one, by the first's kind."""
    out, at = [], 0
    for start, kind, end in sorted(found):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FIELDS = [*((f"n_{kind}", "long", pa.int64()) for kind in KINDS), *((name, "string", pa.string()) for name in ("base_sha256", "spans", "redacted"))]


NAMES = [name for name, _, _ in FIELDS]


def describe_texts(texts: list[str | None], model: PiiModel) -> list[list]:
    rows = []
    for text in texts:
        base, every = spans(text or "", model)
        counts = [sum(s[1] == k for s in base) for k in range(len(KINDS))]
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        rows.append((*counts, digest, joined(every), redacted(text, every) if every else None))
    return [list(c) for c in zip(*rows)]


def annotate(docs: DataFrame, model: PiiModel, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """``docs`` with the columns of ``find``, or under the seven ``names``."""
    fixed = docs.sparkSession.sparkContext.broadcast(model)  # a bounded number of small trees
    fields = [(name, kind, arrow) for name, (_, kind, arrow) in zip(names or NAMES, FIELDS)]
    return map_texts(docs, text_col, lambda: lambda texts: describe_texts(texts, fixed.value), fields)


def find(docs: DataFrame, model: PiiModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: counts of base spans by kind, the digest of the base spans, all spans, and the redacted text
    (null where nothing was found). A null text counts as empty; null and repeated ids keep their rows; other columns
    are not read. A text of any length is searched whole, in linear time; an empty table gives none."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return annotate(base, model).drop("text")
