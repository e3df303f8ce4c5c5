"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base) and from looser ones: what the strict ones drop, other ways to write the
same, and kinds that have no strict pattern (secrets, bank accounts, social security numbers). Six labelers (pattern, shape,
gazetteer, context, checksum, boundary) each vote yes, no or nothing on every candidate. The votes of all documents are
counted by pattern; expectation-maximisation over that bounded table estimates how reliable each labeler is and how likely
each pattern is personal data; a logistic classifier trained on those soft labels decides the looser candidates, which it
refuses or takes. Base spans always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, session, table, without

#: Kinds with a strict pattern, and all kinds, in the order in which spans are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn")
LABELERS = ("pattern", "shape", "gazetteer", "context", "checksum", "boundary")
#: Probability from which a looser candidate becomes a span.
THRESHOLD = 0.9
#: What is believed of each labeler beforehand: how often it is right, and what weight that has beside all its votes.
BELIEFS = {"shape": (0.55, 0.02), "gazetteer": (0.75, 0.05), "context": (0.95, 1.0), "checksum": (0.75, 0.05), "boundary": (0.55, 0.02)}
#: Probability that what a strict pattern vouches for is personal data.
ANCHOR = 0.98

# The base patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser patterns, gazetteers and cue words.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\[dot\]|\(dot\)|\{dot\})\s?|\.)[A-Za-z0-9-]{1,63})+", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:00[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20./-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[./_\x20-]{1,2}[0-9]{4}){3}(?![0-9])")
_DIGIT_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ASSIGNED = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;<>]{6,256})", re.I)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,512}={0,2}(?![A-Za-z0-9_+/=-])")
_MADE = re.compile(r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SHAPE = {
    "email": re.compile(r"[A-Za-z][A-Za-z0-9._%+-]*\s?\W\w*\W?.*[A-Za-z]{2,}"), "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"),
    "card": re.compile(r"[0-9]{4}(?:.{0,2}[0-9]{4}){3}[0-9]{0,3}"), "phone": re.compile(r"(?:\+|00)?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-]?[0-9]{2,4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11,}"), "ssn": _SSN,
}
_TOP_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "eu", "us", "ca", "it", "nl", "ch", "at"}
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36", "38")
_COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
_IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
_CUES = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"}, "ip": {"ip", "address", "host", "server", "from"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"}, "phone": {"phone", "tel", "call", "telephone", "mobile", "fax", "telefon"},
    "secret": {"password", "passwd", "passphrase", "pwd", "secret", "token", "key", "apikey", "auth", "credential", "credentials"},
    "iban": {"iban", "account", "konto", "compte", "cuenta", "bank"}, "ssn": {"ssn", "social", "security"},
}
_ANTI_CUES = {"version", "isbn", "issn", "order", "invoice", "page", "section", "figure", "table", "id", "hash", "date", "build", "rfc", "commit", "sha", "md5", "checksum", "uuid", "revision", "part", "serial"}
_WORD = re.compile(r"[^\W\d_]+")
_SOME_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _is_isbn(digits: str) -> bool:
    return len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(digits)) % 10 == 0


def _is_iban(s: str) -> bool:
    s = s.replace(" ", "")
    return len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _entropy(s: str) -> float:
    """Bits a character."""
    return -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values())


def _strict(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Matches of the strict patterns, by kind as listed, then start, and whether they hold; each kind leftmost and non-overlapping,
    in linear time."""
    at, end = text.find("@"), 0
    while at >= 0:
        low = at
        while low > end and (c := text[low - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            low -= 1
        if low < at and (m := _DOMAIN.match(text, at)):
            yield "email", low, m.end(), True
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _SOME_DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        yield "ip", *m.span(), all(_at_most_255(p) for p in m.group().split("."))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            yield "card", *m.span(), 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)
    if "+" in text:
        for m in _PHONE.finditer(text):
            yield "phone", *m.span(), 8 <= len(_digits(m.group())) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the strict patterns, by kind as listed, then start."""
    return [(kind, start, end) for kind, start, end, holds in _strict(text) if holds]


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


class _Taken:
    """Disjoint spans in order; a span is let in if it touches none."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans: list[tuple[int, int]] = []
        for s in sorted(spans):
            if self.spans and s[0] < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(self.spans[-1][1], s[1]))
            else:
                self.spans.append(s)

    def let_in(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (start, start))
        if k < len(self.spans) and self.spans[k][0] < end or k and self.spans[k - 1][1] > start:
            return False
        insort(self.spans, (start, end))
        return True


def _secret(s: str) -> bool:
    """Whether a run of letters, digits and signs could be a key at all."""
    return bool(_MADE.match(s)) or bool(_SOME_DIGIT.search(s)) and any(c.isalpha() for c in s) and s.count("/") + s.count("-") <= len(s) // 6


def loose_spans(text: str, strict: list[tuple[str, int, int, bool]]) -> list[tuple[str, int, int]]:
    """Further candidates, none touching a base span or an earlier candidate: other kinds and forms first, then what the strict
    patterns dropped."""
    low = text.lower() if any(x in text for x in "([{=:") else ""
    found = [("email", *m.span()) for m in _SPELLED.finditer(text)] if any(x in low for x in ("(at)", "[at]", "{at}")) else []
    if ("=" in text or ":" in text) and any(x in low for x in ("pass", "pwd", "secret", "token", "key", "auth", "credential")):
        found += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _SOME_DIGIT.search(text):
        found += [("iban", *m.span()) for m in _IBAN.finditer(text) if _SOME_DIGIT.search(text, m.start() + 4, m.end())]
        found += [("ssn", *m.span()) for m in _SSN.finditer(text)] if "-" in text else []
        found += [("secret", *m.span()) for m in _TOKEN.finditer(text) if _secret(m.group())]
        found += [("ip", *m.span()) for m in _IP6.finditer(text)] if ":" in text else []
        found += [("card", *m.span()) for p in (_LOOSE_CARD, _DIGIT_RUN) for m in p.finditer(text)]
        found += [(k, s, e) for k, s, e, holds in strict if not holds and (k != "card" or e - s <= 40)]
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    taken = _Taken([(s, e) for _, s, e, holds in strict if holds])
    return [x for x in found if taken.let_in(x[1], x[2])]


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> str:
    """One of y, n, - per labeler."""
    s, digits = text[start:end], _digits(text[start:end])
    say = lambda x: "-" if x is None else "y" if x else "n"
    if kind == "secret":
        kinds = sum((any(c.islower() for c in s), any(c.isupper() for c in s), bool(digits), any(not c.isalnum() for c in s)))
        shape: bool | None = bool(_MADE.fullmatch(s)) or kinds > 2 or bool(_HEX.fullmatch(s)) and len(s) >= 16
    else:
        shape = bool(_SHAPE[kind].fullmatch(s))
    if kind == "email":
        tail = re.split(r"\W+", s.rstrip())[-1].lower()
        known, sound = tail in _TOP_DOMAINS or None, len(s) <= 254
    elif kind == "ip":
        known = None if ":" in s or all(map(_at_most_255, s.split("."))) else False
        sound = not s.startswith("0.") and len(set(re.split("[.:]", s))) > 1
    elif kind == "card":
        known, sound = digits.startswith(_ISSUERS) and not _is_isbn(digits), luhn(digits) and 16 <= len(digits) <= 19
    elif kind == "phone":
        known = digits.removeprefix("00").startswith(_COUNTRIES) if s.startswith(("+", "00")) else False if _is_isbn(digits) else None
        sound = 10 <= len(digits) <= 13 and len(set(digits)) > 2
    elif kind == "secret":
        known, sound = bool(_MADE.fullmatch(s)) or None, _entropy(s) >= 2.5
    elif kind == "iban":
        known, sound = _IBAN_LENGTHS.get(s[:2]) == len(s.replace(" ", "")), _is_iban(s)
    else:
        known, sound = not (digits[:3] in ("000", "666") or digits[0] == "9"), digits[3:5] != "00" and digits[5:] != "0000"
    near = {w.lower() for w in _WORD.findall(text, max(0, start - 40), start)}
    context = True if near & _CUES[kind] else False if near & _ANTI_CUES else None
    around = text[start - 1 : start] + text[end : end + 1]
    vouched = strict or kind == "secret" and bool(_MADE.fullmatch(s))
    return "".join(map(say, (True if vouched else None, shape, known, context, sound, not any(c.isalnum() or c in "_/#" for c in around))))


def features(text: str, start: int, end: int) -> tuple[int, int]:
    """Coarse length and share of digits, 0 to 3 each."""
    n = end - start
    return min(3, n // 10), min(3, 4 * len(_digits(text[start:end])) // n)


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Base spans, then the looser ones; the last value tells them apart."""
    strict = list(_strict(text))
    return [x for x in strict if x[3]] + [(*x, False) for x in loose_spans(text, strict)]


class SpanModel:
    """Labeler reliabilities by expectation-maximisation and a logistic classifier trained on the soft labels.

    Reliability is how often a labeler says yes, when it says anything, of what is personal data and of what isn't; one
    that says the same of both decides nothing. What a strict pattern vouches for is held at ANCHOR throughout.
    """

    def __init__(self, counts: dict[tuple[str, str, int, int], int], rounds: int = 100):
        self.reliability: dict[str, np.ndarray] = {}
        self.prior: dict[str, float] = {}
        self.weights: dict[str, np.ndarray] = {}
        for kind in KINDS:
            rows = sorted(k for k in counts if k[0] == kind)
            if rows:
                self._fit(kind, rows, np.array([counts[r] for r in rows], float), rounds)

    @staticmethod
    def _encode(pattern: str) -> np.ndarray:
        return np.array(["yn-".index(c) for c in pattern])

    def _fit(self, kind: str, rows: list[tuple], n: np.ndarray, rounds: int) -> None:
        v = np.array([self._encode(r[1]) for r in rows])
        said = np.eye(3)[v][:, 1:, :2]  # rows x labelers beside the pattern x yes and no
        sure = v[:, 0] == 0
        yes, no = said[:, :, 0].sum(1), said[:, :, 1].sum(1)
        p = np.where(sure, ANCHOR, (yes + 1) / (yes + 2 * no + 1.5))  # to begin with, a no weighs as two yeses
        right, weight = (np.array(x) for x in zip(*(BELIEFS[x] for x in LABELERS[1:]), strict=True))
        weight = weight * n.sum() + 1
        agree, differ = right * weight, (1 - right) * weight
        pull = np.stack([np.stack([agree, differ], 1), np.stack([differ, agree], 1)])
        for _ in range(rounds):
            prior = float((n @ p + 0.05 * n.sum() + 1) / (1.1 * n.sum() + 2))
            theta = np.stack([np.einsum("r,rlo->lo", n * w, said) + x for w, x in ((p, pull[0]), (1 - p, pull[1]))])
            theta /= theta.sum(2, keepdims=True)
            z = np.einsum("rlo,lo->r", said, np.log(theta[0]) - np.log(theta[1])) + np.log(prior / (1 - prior))
            p = np.where(sure, ANCHOR, 1 / (1 + np.exp(-np.clip(z, -30, 30))))
        self.reliability[kind], self.prior[kind] = theta, prior
        x = np.array([self._inputs(*r[1:]) for r in rows])
        w, scale = np.zeros(x.shape[1]), n / n.sum()
        for _ in range(600):
            g = x.T @ (scale * (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - p)) + 1e-4 * w
            w -= 2.0 * g
        self.weights[kind] = w

    def _inputs(self, pattern: str, length: int, digits: int) -> np.ndarray:
        v = self._encode(pattern)
        return np.concatenate([[1.0], np.eye(3)[v][:, :2].ravel(), np.eye(4)[length], np.eye(4)[digits]])

    def probability(self, kind: str, pattern: str, length: int, digits: int) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-np.clip(self._inputs(pattern, length, digits) @ w, -30, 30))))

    def spans(self, text: str, threshold: float) -> tuple[list, list]:
        """Base spans and all spans, each by kind as listed, then start."""
        base, out = [], []
        for kind, start, end, strict in candidates(text):
            if strict:
                base.append((kind, start, end))
            if strict or self.probability(kind, votes(text, kind, start, end, False), *features(text, start, end)) >= threshold:
                out.append((kind, start, end))
        return base, sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def learn_spans(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Counts vote patterns over all documents, and trains on the counts; at most 7 * 3^6 * 16 sums reach the driver.

    Null and empty texts hold no candidates, very long ones are read whole, equal rows count each. A kind without candidates, as
    in an empty table, gets no classifier, and none of its looser candidates is taken then. Other columns don't matter.
    """
    session(docs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for kind, start, end, strict in candidates(text or ""):
                    key = (kind, votes(text, kind, start, end, strict), *features(text, start, end))
                    n[key] = n.get(key, 0) + 1
        cols = list(zip(*n, strict=True)) if n else [[], [], [], []]
        types = (pa.string(), pa.string(), pa.int32(), pa.int32())
        yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), pa.array(n.values(), pa.int64())], ["kind", "votes", "length", "digits", "n"])

    got = docs.select(text_col).mapInArrow(count, "kind string, votes string, length int, digits int, n long").groupBy("kind", "votes", "length", "digits").agg(F.sum("n").alias("n"))
    return SpanModel({tuple(r)[:4]: r.n for r in got.collect()})


def find_pii(docs: DataFrame, model: SpanModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with base_spans, pii_spans (arrays of kind, start, end in code points, end exclusive) and redacted (the text with each
    span replaced by its kind in angle brackets; null stays null). Base spans of different kinds may overlap; others touch none.

    A null or empty text has no spans. Long texts are read whole; equal texts get equal spans; an empty table gives an empty result;
    input columns of the same names are replaced.
    """
    session(docs)
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(f"base_spans {span}, pii_spans {span}, redacted string")
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            base, full, clean = [], [], []
            for text in batch.to_pylist():
                b, s = model.spans(text or "", threshold)
                base.append(_rows(b)), full.append(_rows(s)), clean.append(redact(text, s))
            yield pa.StructArray.from_arrays([pa.array(base, kind), pa.array(full, kind), pa.array(clean, pa.string())], ["base_spans", "pii_spans", "redacted"])

    own = ("base_spans", "pii_spans", "redacted")
    kept = without(docs, *own)
    return kept.withColumn(inner := free_name(docs), find(F.col(text_col))).select(*[f"`{c}`" for c in kept.columns], *[F.col(f"`{inner}`.{c}").alias(c) for c in own])


def _rows(spans: list) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Overlapping spans become one, named after the first."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs, learn_spans(docs))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *map(count, BASE), F.sha2(_joined("base_spans").cast("binary"), 256).alias("base_sha256"), _joined("pii_spans").alias("spans"),
        F.size("pii_spans").cast("long").alias("n_spans"),
    )


QUERIES = {"op7_pii": op7_pii}
