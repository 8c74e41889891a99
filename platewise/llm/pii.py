"""Personal data by weak supervision.

1. Candidates: the base patterns, whose spans always stay, and looser forms of the same kinds
   (bracketed ``(at)`` mail addresses, dotted or spaced numbers without the base form).
2. Labelers vote +1, 0 or -1 on each candidate: its format, a gazetteer, the words around it, its
   borders and its length.
3. Expectation-maximisation over the counts of all vote patterns of a kind estimates how often
   each labeler votes which way for true and false candidates, and so how likely each pattern is.
4. A logistic classifier is fitted to those probabilities on features of the span itself and its
   votes. It decides on the loose candidates, with probability ``accept`` or more.

Only counts of patterns reach the driver: at most 4 kinds x 3**5 votes x 96 shapes, over all
texts. Offsets are code points, ends are exclusive. Null and empty texts have no spans. Repeated
rows get a row each. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import arrow_map, batch_of, column, text_bytes, texts
from platewise.session import cut_lineage

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number's first digit follows no digit: from inside a run of digits a match fails where it failed from the run's start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# One pass over a run of number characters; + is left to the base form.
LOOSE = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
MASKED = re.compile(r"([A-Za-z0-9._%+-]{1,64}) ?[\[({] ?at ?[\])}] ?((?:[A-Za-z0-9-]{1,63}(?: ?[\[({] ?dot ?[\])}] ?|\.))+[A-Za-z]{2,24})", re.I)
MASK = re.compile(r"[\[({] ?at ?[\])}]", re.I)
# Common top-level domains, card prefixes, calling codes, words around.
TOP = frozenset("com org net edu gov mil int info biz io ai app dev de fr es it uk us ca au eu ch at nl be se no dk fi pl pt ru jp cn in br mx".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91")
CUES = {
    "email": ("mail", "contact", "write", "reach"), "ip": ("ip", "server", "address", "host", "login", "from"),
    "card": ("card", "visa", "credit", "debit", "payment", "account"), "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "cell"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "id", "no", "http", "https", "page", "section", "chapter", "figure", "table", "pp", "vol")
WORDS = re.compile(r"[A-Za-z]+")
PATTERN = "kind int, v1 int, v2 int, v3 int, v4 int, v5 int, shape int"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_emails(text: str):
    """Leftmost matches, found from each @ so that long runs of letters cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, a, b) for a, b in base_emails(text)]
    if DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if octets(m.group())]
        out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := only_digits(m.group())) <= 19 and luhn(d)]
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m.group())) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans: bracketed addresses and numbers of 7 to 19 digits."""
    out = [(0, m.start(), m.end()) for m in MASKED.finditer(text)] if MASK.search(text) else []
    if DIGIT.search(text):
        for m in LOOSE.finditer(text):
            n = len(only_digits(m.group()))
            if 7 <= n <= 19:
                kind = 1 if m.group().count(".") == 3 and n <= 12 and re.fullmatch(r"[0-9.]+", m.group()) else 2 if n >= 13 else 3
                out.append((kind, m.start(), m.end()))
    taken = sorted((a, b) for _, a, b in base)
    free = []
    for k, a, b in out:
        if not any(x < b and a < y for x, y in taken):
            free.append((k, a, b))
    return free


def votes(text: str, kind: int, start: int, end: int, base: bool) -> list[int]:
    """Format, gazetteer, context, borders, length."""
    span = text[start:end]
    digits = only_digits(span)
    name = KINDS[kind]
    if base:
        form = 1
    elif kind == 2:
        form = 1 if luhn(digits) else -1
    elif kind == 1:
        form = 1 if octets(span) else -1
    elif kind == 3:
        form = 1 if re.fullmatch(r"\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}", span) else -1 if span.isdigit() or "." in span and len(span) < 9 else 0
    else:
        form = 0
    if kind == 0:
        known = 1 if WORDS.findall(span)[-1:] and WORDS.findall(span)[-1].lower() in TOP else -1
    elif kind == 2:
        known = 1 if digits.startswith(ISSUERS) else -1
    elif kind == 3:
        known = (1 if digits.startswith(CALLING) else -1) if span.startswith("+") else 0
    else:
        known = -1 if digits.startswith("0") else 0
    near = {w.lower() for w in WORDS.findall(text[max(0, start - 30):start])[-3:]}
    context = 1 if any(w.startswith(c) for w in near for c in CUES[name]) else -1 if near & set(AGAINST) else 0
    before, after = text[start - 1:start], text[end:end + 1]
    border = -1 if before.isalnum() or after.isalnum() or before in ("/", "=", "_") and before or after in ("/", "=", "_") and after else 1
    n = len(digits)
    length = 1 if kind == 0 and len(span) <= 80 or kind == 1 and 4 <= n <= 12 or kind == 2 and n in (15, 16) or kind == 3 and 10 <= n <= 13 else -1 if kind in (2, 3) else 0
    return [form, known, context, border, length]


def shape(text: str, start: int, end: int) -> int:
    """Coarse look of a span: size class, separators, letters, place in its line (96 values)."""
    span = text[start:end]
    size = min(len(span) // 5, 5)
    parts = min(len(re.findall(r"[\x20().-]+", span)), 3)
    letters = int(any(c.isalpha() for c in span))
    ends = int(text[end:end + 1] in ("", "\n", ".", ","))
    return size * 16 + parts * 4 + letters * 2 + ends


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with its base and loose candidates and their votes, flattened to integers."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def work(part):
            flat = []
            for raw in texts(part):
                text = raw.decode("utf-8", "replace")
                base = base_spans(text)
                row: list[int] = []
                for k, a, b in base:
                    row += [k, a, b, 1, *votes(text, k, a, b, True), shape(text, a, b)]
                for k, a, b in loose_spans(text, base):
                    row += [k, a, b, 0, *votes(text, k, a, b, False), shape(text, a, b)]
                flat.append(row)
            ids = column(part, "id")
            yield batch_of(pa.schema([("id", ids.type), ("found", pa.list_(pa.int32()))]), id=ids, found=flat)

        return work

    return arrow_map(docs, [F.col(id_col).alias("id"), text_bytes(text_col)], make, f"id {kind}, found array<int>")


WIDTH = 10  # integers of a candidate


def pattern_counts(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """How often each (kind, votes, shape) occurs in all texts. At most 4 * 3**5 * 96 rows."""
    nth = F.sequence(F.lit(0), F.expr(f"size(found) div {WIDTH} - 1").cast("int"))
    one = found.filter(F.size("found") > 0).select("found", F.explode(nth).alias("i"))
    names = ["kind", "v1", "v2", "v3", "v4", "v5", "shape"]
    places = [0, 4, 5, 6, 7, 8, 9]
    cols = [F.element_at("found", (F.col("i") * WIDTH + p + 1).cast("int")).alias(n) for n, p in zip(names, places, strict=True)]
    return [(tuple(r[n] for n in names), r["rows"]) for r in one.select(*cols).groupBy(*names).agg(F.count("*").alias("rows")).collect()]


def reliabilities(patterns: np.ndarray, weight: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Probability that each vote pattern is true, by expectation-maximisation to convergence."""
    true = 1 / (1 + np.exp(-patterns.sum(1).astype(float)))
    likelihood = -np.inf
    while True:
        logs = []
        for share in (true, 1 - true):
            w = weight * share
            log = np.full(len(weight), np.log((w.sum() + 1) / (weight.sum() + 2)))
            for j in range(patterns.shape[1]):
                for v in (-1, 0, 1):
                    at = patterns[:, j] == v
                    log[at] += np.log((w[at].sum() + 0.5) / (w.sum() + 1.5))
            logs.append(log)
        both = np.logaddexp(*logs)
        now = float((weight * both).sum())
        true = np.exp(logs[0] - both)
        if now - likelihood <= tolerance * abs(now):
            return true
        likelihood = now


def features(kind, v, shp) -> np.ndarray:
    """Indicators of a candidate: kind, each vote, size class, separators, letters, place."""
    kind, v, shp = np.asarray(kind), np.asarray(v), np.asarray(shp)
    cols = [np.ones(len(kind))]
    cols += [(kind == k).astype(float) for k in range(1, 4)]
    cols += [(v[:, j] == s).astype(float) for j in range(v.shape[1]) for s in (-1, 1)]
    cols += [(shp // 16 == s).astype(float) for s in range(1, 6)] + [(shp // 4 % 4 == s).astype(float) for s in range(1, 4)]
    cols += [(shp // 2 % 2).astype(float), (shp % 2).astype(float)]
    return np.column_stack(cols)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method to convergence on soft labels."""
    beta = np.zeros(x.shape[1])
    w = w / w.sum()
    while True:
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (y - p)) - ridge * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        beta += step
        if np.abs(step).max() < 1e-8:
            return beta


def fit_spans(counts: list[tuple[tuple[int, ...], int]]) -> np.ndarray | None:
    """Coefficients of the span classifier from all pattern counts; None without candidates."""
    if not counts:
        return None
    table = np.array([c[0] for c in counts], np.int64)
    weight = np.array([c[1] for c in counts], float)
    true = np.zeros(len(counts))
    for k in range(len(KINDS)):
        at = table[:, 0] == k
        if at.any():
            votes_, back = np.unique(table[at, 1:6], axis=0, return_inverse=True)
            total = np.bincount(back.ravel(), weights=weight[at])
            true[at] = reliabilities(votes_, total)[back.ravel()]
    return logistic(features(table[:, 0], table[:, 1:6], table[:, 6]), true, weight)


def span_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 0.5) -> DataFrame:
    """One row per text: id, counts of the base spans, their digest, and all spans."""
    found = cut_lineage(find_candidates(docs, id_col, text_col))
    beta = fit_spans(pattern_counts(found))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            out: dict[str, list] = {"n_email": [], "n_ip": [], "n_card": [], "n_phone": [], "base_sha256": [], "spans": []}
            for row in b.column(1).to_pylist():
                c = np.array(row or [], np.int64).reshape(-1, WIDTH)
                base = [tuple(r[:3]) for r in c[c[:, 3] == 1].tolist()]
                more = c[c[:, 3] == 0]
                if len(more) and beta is not None:
                    p = 1 / (1 + np.exp(-features(more[:, 0], more[:, 4:9], more[:, 9]) @ beta))
                    more = more[p >= accept]
                for k, n in enumerate(KINDS):
                    out[f"n_{n}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(span_text(base).encode()).hexdigest())
                out["spans"].append(span_text(base + [tuple(r[:3]) for r in more.tolist()]))
            schema = pa.schema([("id", b.column(0).type), *((f"n_{n}", pa.int64()) for n in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
            yield batch_of(schema, id=b.column(0), **out)

    return found.mapInArrow(run, f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string").withColumnRenamed("id", id_col)
