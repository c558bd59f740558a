"""Personal data by weak supervision.

Strict patterns give base spans (email, ip, card, phone), which always stay. Looser patterns propose further candidates:
spelled-out addresses, numbers without a plus, cards with other separators, IPv6; and kinds that have no base spans: bank
account numbers, national identity numbers, keys and passwords (numbers within these are no phones or cards). On every candidate, base spans
included, three labelers vote yes, no or nothing: a shape labeler (check digits, lengths, mixed characters), a gazetteer labeler (top-level
domains, issuer, dialling, country and key prefixes) and a context labeler (cue words before the span). The vote patterns of all documents
are counted; expectation-maximisation over the counts estimates each labeler's reliability for each kind, and its
posteriors train the final classifier, a logistic model over votes and the form of the span. Candidates that it accepts
and that overlap no base span are added.

Defined cases: null and empty texts have no spans; the digest of no spans is that of the empty string; without candidates
nothing is learned and nothing added; of overlapping added spans the first, then the longest stays (ties by kind); repeated rows and
rows that share a doc_id are judged each; a very long text is searched whole, in linear time; a null doc_id is kept; other
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds that have no base spans: bank account numbers, national identity numbers, keys and passwords.
ADDED = ("iban", "id", "secret")
ALL = KINDS + ADDED
#: Gazetteers and cue words (fixed values).
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io ai co uk us ca de fr es it nl be ch at eu ru cn jp br in au".split())
DIALLING = ("00", "01", "02", "03", "04", "05", "06", "07", "08", "09", "1800", "800", "888", "555")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38")
CUES = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "login", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "cell", "whatsapp", "contact", "llama", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "id": ("ssn", "social security", "tax id", "passport", "identity", "ausweis", "seguridad social", "insurance"),
    "secret": ("token", "secret", "passw", "pwd", "api", "key", "auth", "bearer", "credential", "clave", "passwort"),
}
#: Country codes of bank accounts with the whole length, and beginnings of issued keys (fixed values).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26,
}
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "hf_", "npm_")
COUNTER_CUES = ("version", "isbn", "serial", "order", "sha", "hash", "commit", "checksum", "digest", "build", "invoice", "date", "page")
#: Characters before a span in which cues are looked for.
WINDOW = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A run of characters that only numbers are made of; every ip, card and phone lies within one.
_RUN = re.compile(r"[0-9+][0-9 ().+\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ .-]{1,2}[0-9]{2,4}){2,4}(?![0-9])")
_LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ .-]{0,2}[0-9]){12,18}(?![0-9])")
_LONG_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")
_AT = re.compile(r"[\[( {]at[\]) }]", re.IGNORECASE)
_SPELLED = re.compile(r"\s?[A-Za-z0-9-]{1,63}(?:(?:\s?[\[({]dot[\])}]\s?|\sdot\s|\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}([ -])[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z-])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{20,512}={0,2}(?![A-Za-z0-9_+/=-])")
_ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|secret|api[ _-]?key|token|passwort)\s{0,3}[:=]\s{0,3}[\"']?([^\s\"',;]{6,128})")
_CUE = {k: re.compile("|".join(v)) for k, v in CUES.items()}
_COUNTER = re.compile("|".join(COUNTER_CUES))
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in text.split(".")))


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict spans by kind as listed, then start; linear in the length of the text."""
    found: dict[str, list] = {k: [] for k in KINDS}
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found["email"].append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a < 4:
            continue
        found["ip"] += [m.span() for m in _IP.finditer(text, a, b) if _octets(m[0])]
        for m in _CARD.finditer(text, a, b):
            d = _digits(m[0])
            if 16 <= len(d) <= 19 and luhn(d):
                found["card"].append(m.span())
        found["phone"] += [m.span() for m in _PHONE.finditer(text, a, b) if 8 <= len(_digits(m[0])) <= 15]
    return [(k, *s) for k in KINDS for s in found[k]]


def iban_valid(text: str) -> bool:
    """The length of its country and the check digits."""
    t = text.replace(" ", "")
    return IBAN_LENGTHS.get(t[:2]) == len(t) and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def _varied(text: str) -> bool:
    """Digits and letters mixed, as in keys and not in words: at least a sixth of digits, or both cases with digits."""
    digits, upper, lower = (sum(map(f, text)) for f in (str.isdigit, str.isupper, str.islower))
    return bool(upper + lower) and (digits * 6 >= len(text) or bool(digits and upper and lower))


def added_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the kinds without base spans."""
    out = [("iban", *m.span()) for m in _IBAN.finditer(text)]
    out += [("id", *m.span()) for m in _ID.finditer(text)]
    # the slow patterns only where a plain search says that they can match
    if max(map(len, text.split()), default=0) >= 20:
        out += [("secret", *m.span()) for m in _TOKEN.finditer(text) if m[0].startswith(KEY_STARTS) or _varied(m[0])]
    low = text.lower()
    if any(word in low for word in ("passw", "pwd", "secret", "api", "token")):
        out += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text) if "[" not in m[1]]
    return out


def _taken(spans: list[tuple[int, int]]):
    """Whether a range overlaps one of the spans."""
    spans = sorted(spans)
    starts, tops = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def overlaps(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and tops[i - 1] > a

    return overlaps


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates beyond the strict patterns; they may overlap each other and base spans. Numbers within those of the added
    kinds are no cards and phones."""
    own = added_spans(text)
    out, taken = [], _taken([(a, b) for _, a, b in own])
    for m in _AT.finditer(text):
        start = m.start()
        if start and text[start - 1] == " ":
            start -= 1
        left = start
        while left and text[left - 1] in _LOCAL and start - left < 64:
            left -= 1
        n = _SPELLED.match(text, m.end())
        plain = m[0][0] == m[0][-1] == " "  # "at" between spaces is a word like any other, unless the dot is spelled out too
        if n and left < start and (" dot " in n[0].lower() if plain else m[0][0] + m[0][-1] in ("[]", "()", "{}")):
            out.append(("email", left, n.end()))
    for run in _RUN.finditer(text):
        a, b = run.span()
        if b - a >= 9:
            numbers = [("card", *m.span()) for m in _LOOSE_CARD.finditer(text, a, b)]
            numbers += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text, a, b)]
            out += [n for n in numbers if not taken(n[1], n[2])]
    if text.count(":") >= 7:
        out += [("ip", *m.span()) for m in _LONG_IP.finditer(text)]
    # a failed check digit is final, but the digits of a mistyped account are no phone
    return out + [o for o in own if o[0] != "iban" or iban_valid(text[o[1] : o[2]])]


def votes(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[int, int, int, int]:
    """Votes (1 yes, -1 no, 0 none) of shape, gazetteer and context, and the form of the span (0 to 3)."""
    span, digits = text[start:end], _digits(text[start:end])
    before = text[max(0, start - WINDOW) : start].lower()
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        shape = 1 if strict else 0
        gazetteer = 1 if last in TOP_DOMAINS else -1
        form = 0 if strict else (1 if re.search(r"[\[({]", span) else 2)
    elif kind == "ip":
        shape = 1
        gazetteer = -1 if span in ("0.0.0.0", "127.0.0.1", "255.255.255.255") else 0
        form = 0 if strict else 1
    elif kind == "card":
        shape = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUERS.match(digits) else -1
        form = (len(digits) < 16) + 2 * (not strict)
    elif kind == "iban":
        shape = 1 if iban_valid(span) else -1
        gazetteer = 1 if span[:2] in IBAN_LENGTHS else -1
        form = int(" " in span)
    elif kind == "id":
        shape = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
        gazetteer = 0
        form = int("-" in span)
    elif kind == "secret":
        shape = 1 if _varied(span) and len(set(span)) * 4 >= min(len(span), 40) else -1
        gazetteer = 1 if span.startswith(KEY_STARTS) else 0
        form = 0 if re.fullmatch("[0-9a-f]+", span) else 1
    else:
        shape = 1 if 8 <= len(digits) <= 15 and (strict or "-" in span or "(" in span) else (-1 if not 9 <= len(digits) <= 13 else 0)
        gazetteer = 1 if strict or digits.startswith(DIALLING) else -1
        form = 0 if strict else (1 if "(" in span else 2)
    context = 1 if _CUE[kind].search(before) else (-1 if _COUNTER.search(before) else 0)
    return shape, gazetteer, context, form


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple]]:
    """Base spans and the loose ones that overlap none of them, each with its votes."""
    base = base_spans(text)
    out = [(k, a, b, True, votes(text, k, a, b, True)) for k, a, b in base]
    taken = _taken([(a, b) for _, a, b in base])
    for k, a, b in sorted(loose_spans(text), key=lambda s: (s[1], -s[2], s[0])):
        if not taken(a, b):
            out.append((k, a, b, False, votes(text, k, a, b, False)))
    return out


#: Share of wrong votes assumed before any is seen; the votes' agreement moves it.
PRIOR_WRONG, PRIOR_WEIGHT = 0.2, 5.0


def estimate(counts: dict[tuple, int], steps: int = 100) -> tuple[dict, dict]:
    """Expectation-maximisation over counts of (kind, shape, gazetteer, context, form): the probability of each pattern to
    be personal data, and each labeler's reliability (share of its votes that are right) by kind."""
    posterior, reliability = {}, {}
    for kind in {k[0] for k in counts}:
        rows = sorted((k, n) for k, n in counts.items() if k[0] == kind)
        v = np.array([k[1:4] for k, _ in rows])
        n = np.array([c for _, c in rows], float)
        right = np.full(3, 1 - PRIOR_WRONG)
        share = 0.5
        for _ in range(steps):
            pull = (v * np.log(right / (1 - right))).sum(1) + np.log(share / (1 - share))
            p = 1 / (1 + np.exp(-np.clip(pull, -30, 30)))
            agree = (n[:, None] * np.where(v > 0, p[:, None], np.where(v < 0, 1 - p[:, None], 0))).sum(0)
            cast = (n[:, None] * (v != 0)).sum(0)
            fresh = np.clip((agree + PRIOR_WEIGHT * (1 - PRIOR_WRONG)) / (cast + PRIOR_WEIGHT), 0.05, 0.995)
            share = float(np.clip((n * p).sum() / n.sum(), 0.05, 0.95))
            moved, right = np.abs(fresh - right).max(), fresh
            if moved < 1e-9:
                break
        posterior |= {k: float(x) for (k, _), x in zip(rows, p)}
        reliability[kind] = right.tolist()
    return posterior, reliability


def _vector(pattern: tuple) -> np.ndarray:
    """What the classifier sees of a pattern: bias, votes and form, by kind."""
    kind, shape, gazetteer, context, form = pattern
    one = np.zeros(1 + 6 + 4)
    one[0] = 1
    for i, v in enumerate((shape, gazetteer, context)):
        one[1 + 2 * i] = v > 0
        one[2 + 2 * i] = v < 0
    one[7 + form] = 1
    out = np.zeros(len(one) * len(ALL))
    at = ALL.index(kind) * len(one)
    out[at : at + len(one)] = one
    return out


def fit_classifier(counts: dict[tuple, int], posterior: dict[tuple, float]) -> np.ndarray:
    """Logistic weights fitted to the posteriors, each pattern weighted by the root of its count."""
    if not counts:
        return np.zeros(11 * len(ALL))
    keys = sorted(counts)
    x, y, n = np.array([_vector(k) for k in keys]), np.array([posterior[k] for k in keys]), np.sqrt([counts[k] for k in keys])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.1 * w)
        w = w + move
        if np.abs(move).max() < 1e-9:
            break
    return w


def _texts(batch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def learn(docs: DataFrame) -> dict:
    """Vote patterns of all documents, counted; at most 7 * 27 * 4 rows come to the driver."""

    def run(batches):
        seen: Counter = Counter()
        for batch in sliced(batches):
            for t in _texts(batch):
                seen.update((k, *v) for k, _, _, _, v in candidates(t))
        keys = list(seen)
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array([k[0] for k in keys], pa.string()),
            **{c: pa.array([k[i + 1] for k in keys], pa.int32()) for i, c in enumerate(("shape", "gazetteer", "context", "form"))},
            "n": pa.array([seen[k] for k in keys], pa.int64()),
        })

    rows = docs.select("text").mapInArrow(run, "kind string, shape int, gazetteer int, context int, form int, n long")
    rows = rows.groupBy("kind", "shape", "gazetteer", "context", "form").agg(F.sum("n").alias("n"))
    counts = {tuple(r)[:5]: r["n"] for r in rows.collect()}
    posterior, reliability = estimate(counts)
    return {"counts": counts, "posterior": posterior, "reliability": reliability, "weights": fit_classifier(counts, posterior)}


def find(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and spans: kind, start, end, base (a strict span) and probability; base spans stay whatever the classifier."""
    weights = model["weights"]

    def run(batches):
        known: dict[tuple, float] = {}
        for batch in sliced(batches):
            spans = []
            for t in _texts(batch):
                found, free = [], 0
                for k, a, b, strict, v in candidates(t):
                    key = (k, *v)
                    if key not in known:
                        known[key] = float(1 / (1 + np.exp(-np.clip(_vector(key) @ weights, -30, 30))))
                    if strict:
                        found.append({"kind": k, "start": a, "end": b, "base": True, "probability": known[key]})
                    elif known[key] >= 0.5 and a >= free:
                        free = b
                        found.append({"kind": k, "start": a, "end": b, "base": False, "probability": known[key]})
                spans.append(sorted(found, key=lambda s: (ALL.index(s["kind"]), s["start"])))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, spans array<struct<kind:string,start:long,end:long,base:boolean,probability:double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find(docs, learn(docs))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
        F.size("spans").cast("long").alias("n_spans"),
    )
