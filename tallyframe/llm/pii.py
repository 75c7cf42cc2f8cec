"""Personal data by weak supervision.

Candidates are found by base patterns and by looser ones. Four labelers vote on each (-1, 0, 1): a shape regex, a
checksum or range rule, a gazetteer (top-level domains, card issuers, calling codes, public address blocks) and the
words before the candidate. Votes and features are counted over all documents by code; there are at most 2**21
codes whatever the input, so the counts fit on the driver. Expectation-maximisation (one latent label, labelers
independent given it) estimates each labeler's reliability for each kind, and its posteriors train a logistic
span classifier on the candidates' features. Candidates of the base patterns are always spans; the classifier adds
looser candidates that overlap none of them, but no ip or card whose range or checksum fails: these only teach it.

Base patterns, leftmost and non-overlapping for each kind; matches that fail are dropped without retries:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+){3}`` with parts at most 255;
card ``[0-9]([\\x20-]?[0-9])+`` with 14 to 19 digits passing Luhn; phone ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 10 to 15
digits. Every search takes time in proportion to the text.

An address with both signs spelled out as bare words (``at``, ``dot``) is a candidate only with a known last label and a
word of mail (mail, contact, write and so on) in the 40 characters before it; one bracketed sign is enough otherwise.

Null text counts as empty and has no spans (``redacted`` keeps it null). Empty tables give empty results; repeated
rows are handled each; extra columns are ignored by ``spans`` and carried by ``redacted``.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, staged, text_only

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a run of digits is tried once, from its start: inside it the outcome is the same
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+])(?<![0-9][ .-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,5}(?![ .-]?[0-9])")
_LOOSE_EMAIL = re.compile(r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?| at )[a-z0-9-]{1,63}(?:(?: ?[\[(]dot[\])] ?| dot )[a-z0-9-]{2,63})+")
_BRACKET = re.compile(r"[\[(]")
_STRICT_PHONE = re.compile(r"\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}\Z")
_DIGITS = re.compile(r"[0-9]+")
_BEFORE = re.compile(r"[^\W\d_]+")

# Gazetteers.
TOP_LEVEL = frozenset("com org net edu gov io de fr es it uk us eu info biz ch at nl be se no dk fi pl pt br mx jp cn in ru au ca".split())
CALLING_CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "35", "36", "30", "6011", "65", "62")
CONTEXT = {
    "email": frozenset("mail email contact write reply correo courriel adresse".split()),
    "ip": frozenset("ip host server address login from client".split()),
    "card": frozenset("card visa mastercard amex credit payment karte tarjeta carte".split()),
    "phone": frozenset("tel phone call fax mobile cell telefon telefono telephone".split()),
}
AGAINST = frozenset("version release isbn order invoice id number no page chapter section commit build".split())


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        total += (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)]
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, each found from its ``@``: no other character of an address can be one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = start < at and _DOMAIN.match(text, at + 1)
        if found:
            done = found.end()
            yield start, done
            at = text.find("@", done)
        else:
            done = at + 1  # an address can't reach back over this sign
            at = text.find("@", at + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _loose(text: str):
    for m in _IP.finditer(text):
        yield m.start(), 1, m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 40:
            yield m.start(), 2, m.end()
    for m in _LOOSE_PHONE.finditer(text):
        yield m.start(), 3, m.end()
    for m in _LOOSE_EMAIL.finditer(text):
        if _BRACKET.search(m[0]) or _spelled_out(text, m):
            yield m.start(), 0, m.end()


def _spelled_out(text: str, m: re.Match) -> bool:
    """Without brackets an address is prose as well ("meet at noon dot com"): a known last label and a word of mail before it decide."""
    before = {w.lower() for w in _BEFORE.findall(text[max(0, m.start() - 40) : m.start()])}
    return m[0].rsplit(" ", 1)[1].lower() in TOP_LEVEL and not before.isdisjoint(CONTEXT["email"])


def code_of(text: str, start: int, kind: int, end: int) -> int:
    """Votes and features of a candidate as one number under 2**21."""
    found = text[start:end]
    digits = "".join(_DIGITS.findall(found))
    name = KINDS[kind]
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]+", found)[-1].lower()
        shape, rule, known = ("@" in found) * 2 - 1, (1 if last.isalpha() and len(last) >= 2 else -1), (1 if last in TOP_LEVEL else 0)
    elif kind == 1:
        parts = found.split(".")
        shape = 1 if all(len(p) <= 3 and (p == "0" or p[:1] != "0") for p in parts) else -1
        rule = 1 if all(map(_small, parts)) else -1
        known = -1 if parts[0].lstrip("0") in ("", "127") else 1 if rule == 1 and int(parts[0]) < 224 else 0
    elif kind == 2:
        shape = 1 if len(digits) in (14, 15, 16) else 0 if len(digits) <= 19 else -1
        rule = 1 if 14 <= len(digits) <= 19 and _luhn(digits) else -1
        known = 1 if digits.startswith(ISSUERS) else -1
    else:
        shape = 1 if found[0] == "+" or _STRICT_PHONE.match(found) else -1
        rule = 1 if 10 <= len(digits) <= 15 else -1
        known = 1 if found[0] != "+" and len(digits) == 10 and digits[0] > "1" or found[0] == "+" and digits.startswith(CALLING_CODES) else 0
    before = {w.lower() for w in _BEFORE.findall(text[max(0, start - 40) : start])}
    context = 1 if before & CONTEXT[name] else -1 if before & AGAINST else 0
    left = text[start - 1 : start]
    right = text[end : end + 1]
    side = lambda c: 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in ".,;:!?)\"'" else 3
    length = min(7, len(found) // 4)
    gap = 0 if found.isalnum() else 1 if " " in found else 2
    code = kind
    for value, base in ((shape + 1, 3), (rule + 1, 3), (known + 1, 3), (context + 1, 3), (length, 8), (side(left), 4), (side(right), 4), (gap, 3)):
        code = code * base + value
    return code


_BASES = (3, 3, 3, 3, 8, 4, 4, 3)


def fields(codes: np.ndarray) -> np.ndarray:
    """Columns kind, four votes (0 against, 1 silent, 2 for), length, left, right, gap."""
    out, rest = [], np.asarray(codes, np.int64)
    for base in reversed(_BASES):
        out.append(rest % base)
        rest = rest // base
    return np.stack([rest, *out[::-1]], axis=1)


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """Base spans, and (start, kind, end, code) of looser candidates that overlap none of them."""
    base = base_spans(text)
    loose, seen, starts, ends = [], set(), [], []
    for a, b in sorted((a, b) for a, _, b in base):  # their union, as disjoint spans
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for a, kind, b in sorted(_loose(text)):
        k = bisect.bisect_left(starts, b) - 1  # the last span that starts before b
        if (a, b) not in seen and (k < 0 or ends[k] <= a):
            seen.add((a, b))
            loose.append((a, kind, b, code_of(text, a, kind, b)))
    return base, loose


#: Votes (against, silent, for) of true and of false candidates that each labeler starts with. Labelers are better than
#: chance; a checksum or range rule hardly ever speaks against a true one, however few candidates there are.
PRIOR_VOTES = (((0.5, 1.0, 2.0), (2.0, 1.0, 0.5)), ((0.1, 1.0, 20.0), (20.0, 1.0, 2.0)), ((0.5, 1.0, 2.0), (2.0, 1.0, 0.5)), ((0.5, 1.0, 2.0), (2.0, 1.0, 0.5)))


@dataclass(frozen=True)
class SpanModel:
    reliability: np.ndarray  # kind x labeler x label x vote
    prior: np.ndarray  # kind
    weights: np.ndarray  # of the classifier, by kind and feature value

    def probability(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        f = fields(codes)
        p = 1 / (1 + np.exp(-np.clip(self.weights[_columns(f)].sum(axis=1), -40, 40)))
        # no address or card by definition, whatever else speaks for it: a range or checksum that fails
        return np.where(np.isin(f[:, 0], (1, 2)) & (f[:, 2] == 0), 0.0, p)


def _columns(f: np.ndarray) -> np.ndarray:
    """One column of the classifier for each field of a candidate, by kind; the last is the kind's own."""
    starts = np.cumsum([0, *_BASES])
    return np.concatenate([f[:, :1] * (starts[-1] + 1) + starts[:-1] + f[:, 1:], f[:, :1] * (starts[-1] + 1) + starts[-1]], axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> SpanModel:
    """Expectation-maximisation over vote patterns, then a logistic classifier on its posteriors."""
    order = np.argsort(codes)
    codes, counts = np.asarray(codes, np.int64)[order], np.asarray(counts, np.float64)[order]
    f = fields(codes)
    votes, kind = f[:, 1:5], f[:, 0]
    agree = (votes - 1).sum(axis=1)
    q = 1 / (1 + np.exp(-1.5 * (agree - 1.0 - 2.0 * (votes[:, 1] == 0))))
    reliability, prior = np.full((4, 4, 2, 3), 1 / 3), np.full(4, 0.5)
    for _ in range(rounds):
        for k in range(4):
            mine = kind == k
            n = counts[mine]
            on, off = (n * q[mine]).sum(), (n * (1 - q[mine])).sum()
            prior[k] = (on + 1) / (on + off + 2)
            for j in range(4):
                for v in range(3):
                    at = votes[mine, j] == v
                    for_, against = PRIOR_VOTES[j]
                    reliability[k, j, 1, v] = ((n * q[mine])[at].sum() + for_[v]) / (on + sum(for_))
                    reliability[k, j, 0, v] = ((n * (1 - q[mine]))[at].sum() + against[v]) / (off + sum(against))
        lift = np.log(prior[kind] / (1 - prior[kind]))
        for j in range(4):
            lift += np.log(reliability[kind, j, 1, votes[:, j]] / reliability[kind, j, 0, votes[:, j]])
        q = 1 / (1 + np.exp(-np.clip(lift, -30, 30)))
    columns = _columns(f)
    width = 4 * (sum(_BASES) + 1)
    w = np.zeros(width)
    share = counts / max(counts.sum(), 1)
    m, v = np.zeros(width), np.zeros(width)
    for step in range(1, 401 if len(codes) else 1):
        p = 1 / (1 + np.exp(-np.clip(w[columns].sum(axis=1), -30, 30)))
        g = np.bincount(columns.ravel(), weights=np.repeat((p - q) * share, columns.shape[1]), minlength=width) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return SpanModel(reliability, prior, w)


def _suspects(texts: pa.Array) -> np.ndarray:
    """Rows that can hold a candidate at all."""
    return pc.match_substring_regex(texts, r"[0-9]|@|[\[(](?i:at|dot)[\])]| (?i:dot) ").to_numpy(zero_copy_only=False)


FOUND = "doc_id long, b_start array<long>, b_kind array<long>, b_end array<long>, b_code array<long>, c_start array<long>, c_kind array<long>, c_end array<long>, c_code array<long>"


def found(docs: DataFrame) -> DataFrame:
    """Base spans and looser candidates of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            rows = [[[] for _ in range(8)] for _ in range(batch.num_rows)]
            for k in np.flatnonzero(_suspects(texts)):
                text = texts[int(k)].as_py()
                base, loose = candidates(text)
                rows[k] = [*(list(x) for x in (zip(*base) if base else [()] * 3)), [code_of(text, *x) for x in base], *(list(x) for x in (zip(*loose) if loose else [()] * 4))]
            columns = [pa.array([r[c] for r in rows], pa.list_(pa.int64())) for c in range(8)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], [c.split()[0] for c in FOUND.split(", ")])

    return text_only(docs).mapInArrow(frugal(run), FOUND)


def code_counts(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each code occurs over all candidates, those of the base patterns included."""
    rows = table.select(F.explode(F.concat("b_code", "c_code")).alias("code")).groupBy("code").count().toPandas()
    return rows["code"].to_numpy(np.int64), rows["count"].to_numpy(np.float64)


def _text_of(base, more) -> tuple[str, str]:
    name = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(name(base).encode()).hexdigest(), name(sorted([*base, *more]))


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def spans(docs: DataFrame) -> DataFrame:
    """Per document: counts and digest of base spans, all spans, and how many the classifier added."""
    table = staged(found(docs), "pii-candidates")
    model = docs.sparkSession.sparkContext.broadcast(fit(*code_counts(table)))

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, bs, bk, be, _, cs, ck, ce, cc in zip(*(c.to_pylist() for c in batch.columns)):
                base = list(zip(bs, bk, be))
                good = model.value.probability(np.array(cc, np.int64)) >= ACCEPT if cc else []
                more = [x for x, ok in zip(zip(cs, ck, ce), good) if ok]
                counts = [bk.count(k) for k in range(4)]
                rows.append((doc_id, *counts, *_text_of(base, more), len(more)))
            names = [c.split()[0] for c in SPANS.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 8, kinds)], names)

    return table.mapInArrow(frugal(run), SPANS)


def mask(text: str, places: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for a, kind, b in sorted(places):
        if a >= done:
            out += [text[done:a], f"[{KINDS[kind].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` with personal data masked in text (and n_chars, if there, made to fit)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*code_counts(found(docs))))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            flags = pc.fill_null(pa.array(_suspects(pc.fill_null(texts, "")).astype(bool)), False).to_numpy(zero_copy_only=False)
            changed = {}
            for k in np.flatnonzero(flags):
                text = texts[int(k)].as_py()
                if text is None:
                    continue
                base, loose = candidates(text)
                good = model.value.probability(np.array([x[3] for x in loose], np.int64)) >= ACCEPT
                places = base + [x[:3] for x, ok in zip(loose, good) if ok]
                if places:
                    changed[int(k)] = mask(text, places)
            columns = list(batch.columns)
            if changed:
                flag = np.zeros(batch.num_rows, bool)
                flag[list(changed)] = True
                columns[at] = pc.replace_with_mask(texts, pa.array(flag), pa.array([changed[k] for k in sorted(changed)], texts.type))
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    out = docs.mapInArrow(frugal(run), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(documents(spark, sf_dir))


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op1_pii`` that SQL can express."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def _sql_matches(kind: int, pattern: str, good: str) -> str:
    """Matches of one kind with their places: the texts between matches and the matches before add up to a match's start."""
    return f"""
  SELECT doc_id, {kind} AS kind, m, a, a + length(m) AS b FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS a
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d) x WHERE len(ms) > 0) y
  WHERE {good}"""


_DIGITS_SQL = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i: CASE WHEN (length({_DIGITS_SQL}) - i) % 2 = 0 THEN CAST({_DIGITS_SQL}[i] AS INTEGER) ELSE CAST({_DIGITS_SQL}[i] AS INTEGER) * 2 // 10 + CAST({_DIGITS_SQL}[i] AS INTEGER) * 2 % 10 END)) % 10 = 0"
PII_BASE_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        _sql_matches(kind, pattern, good)
        for kind, (pattern, good) in enumerate(
            [
                (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
                (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255"),
                (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 14 AND 19 AND {_LUHN_SQL}"),
                (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 10 AND 15"),
            ]
        )
    )
    + """)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_email, count(*) FILTER (kind = 1) AS n_ip, count(*) FILTER (kind = 2) AS n_card, count(*) FILTER (kind = 3) AS n_phone,
  sha256(coalesce(string_agg(CASE kind WHEN 0 THEN 'email' WHEN 1 THEN 'ip' WHEN 2 THEN 'card' WHEN 3 THEN 'phone' END || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, kind), '')) AS base_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id"""
)
