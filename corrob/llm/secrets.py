"""Secret scans: sliding-window Shannon entropy per character class, beside fixed patterns.

Candidate strings are maximal runs of key-like characters that the allow-list doesn't know. A candidate is parted at
``/``, ``_``, ``-``, ``=`` and ``+``; parts that are plain (numbers, words, words run together as in names of programs, with a
few digits around them) are let off, and only what other parts make together is looked at. So a word or a date in a path excuses itself and not its neighbour. Each character class looks
at the runs of its own characters in that: hexadecimal digits, capitals with digits (base32), small letters with
digits, letters of one case, and the candidate as a whole (base64, mixed keys). A window moves over each run; its
entropy follows from the counts of its characters, of which a step changes two. Windows at or above the threshold of
their class are united to spans. The thresholds lie between random keys and words run together; for letters of one case
that takes longer windows, and runs of digits alone are no keys. Spans of the fixed patterns always stay; spans by
entropy that they cover entirely add nothing and are left out, others stay whole.

Null texts count as empty, and an empty text has no spans. Very long texts are scanned whole, in linear time. Repeated
rows give repeated results; ``doc_id`` is carried as it is, null included. Other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import free_name, utf8

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KINDS_OF_CHARACTERS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
# Whole candidates of high entropy that are no secrets: UUIDs, integrity digests of lock files, documented sample keys, paths and names of words.
ALLOWED = (
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"sha(?:1|256|384|512)-.*",
    r"(?:.*[A-Za-z0-9])?EXAMPLE(?:[A-Za-z0-9].*)?",
    r"(?!.*[a-z]{32})/?[a-z_-]+(?:/[a-z_-]+)*/?",
)


#: Parts of candidates that are no secrets: alphabets.
SAMPLES = ("0123456789", "abcdefghij", "ABCDEFGHIJ")
PARTS = re.compile(r"[^/_=+-]+")
AROUND = re.compile(r"\d{0,4}([A-Za-z]*)\d{0,6}|(\d+)")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class CharacterClass:
    """runs: pattern of the strings looked at; kinds: of small letters, capitals and digits, so many at least; window: characters; bits: least entropy of a window."""

    name: str
    runs: str
    kinds: int
    window: int
    bits: float


CLASSES = (
    CharacterClass("hex", r"[0-9A-Fa-f]{20,}", 2, 20, 3.05),
    CharacterClass("upper", r"[A-Z0-9]{20,}", 2, 20, 3.4),
    CharacterClass("lower", r"[a-z0-9]{20,}", 2, 20, 3.6),
    CharacterClass("letters", r"[a-z]{32,}|[A-Z]{32,}", 1, 32, 4.0),
    CharacterClass("mixed", r"[A-Za-z0-9+/_=-]{20,}", 2, 20, 3.9),
)


@dataclass(frozen=True)
class SecretParams:
    """classes: of characters, with their windows and thresholds; allowed: patterns of whole candidates.

    plain: whether plain parts of candidates are let off, and runs of which more than ``most_digits`` are digits, hexadecimal ones aside.
    """

    classes: tuple[CharacterClass, ...] = field(default=CLASSES)
    allowed: tuple[str, ...] = field(default=ALLOWED)
    plain: bool = True
    most_digits: float = 0.6


class Scanner:
    """The patterns of SecretParams, compiled."""

    def __init__(self, p: SecretParams = SecretParams()):
        self.classes = [(re.compile(c.runs), c.kinds, c.window, c.bits, p.most_digits if p.plain and c.name != "hex" else 1.0) for c in p.classes]
        self.plain = p.plain
        self.allowed = re.compile("|".join(f"(?:{x})" for x in p.allowed) or r"(?!)")


def is_plain(part: str) -> bool:
    """A number, or words with a few digits around them: one word under 32 letters, or several of three letters on average."""
    m = AROUND.fullmatch(part)
    if not m:
        return any(x in part for x in SAMPLES)
    letters = m[1] or ""
    if not letters or letters.islower() or letters.isupper():
        return len(letters) < 32
    return len(letters) >= 3 * len(WORDS.findall(letters))


def key_stretches(candidate: str) -> list[tuple[int, int]]:
    """(start, end) of what a candidate's parts that aren't plain make together, with short plain ones between two of them."""
    parts = [(m.start(), m.end()) for m in PARTS.finditer(candidate)]
    keys = [not is_plain(candidate[s:e]) for s, e in parts]
    joined = [k or (0 < i < len(keys) - 1 and keys[i - 1] and keys[i + 1] and e - s <= 4) for i, (k, (s, e)) in enumerate(zip(keys, parts))]
    out: list[tuple[int, int]] = []
    before = False
    for (s, e), key in zip(parts, joined):
        if key:
            out[-1:] = [(out[-1][0], e)] if before else [*out[-1:], (s, e)]
        before = key
    padded = [(s, e + len(candidate[e:]) - len(candidate[e:].lstrip("="))) for s, e in out[-1:]]
    return out[:-1] + padded


def window_entropies(text: str, window: int) -> list[float]:
    """Entropy in bits of each window of ``text``; one window of the whole text if that is shorter."""
    window = min(window, len(text))
    if not window:
        return []
    weigh = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    out = []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weigh[n + 1] - weigh[n] if n < window else 0.0
        if i >= window:
            old = text[i - window]
            n = counts[old]
            counts[old] = n - 1
            total += weigh[n - 1] - weigh[min(n, window)]
        if i >= window - 1:
            out.append(math.log2(window) - total / window)
    return out


def windows_of(text: str, at: int, scanner: Scanner) -> list[tuple[int, int]]:
    """Windows of enough entropy in a stretch that begins at ``at``."""
    found = []
    for runs, kinds, window, least, most_digits in scanner.classes:
        for run in runs.finditer(text):
            if sum(k.search(run[0]) is not None for k in KINDS_OF_CHARACTERS) < kinds or sum(map(str.isdigit, run[0])) > most_digits * len(run[0]):
                continue
            start = at + run.start()
            for i, bits in enumerate(window_entropies(run[0], window)):
                if bits >= least:
                    found.append((start + i, start + i + min(window, len(run[0]))))
    return found


def entropy_spans(text: str, scanner: Scanner) -> list[tuple[int, int]]:
    """The unions of windows of enough entropy, by start."""
    found: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        if scanner.allowed.fullmatch(m[0]):
            continue
        for start, end in key_stretches(m[0]) if scanner.plain else [(0, len(m[0]))]:
            found += windows_of(m[0][start:end], m.start() + start, scanner)
    spans: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(e, spans[-1][1]))
        else:
            spans.append((s, e))
    return spans


def find_spans(text: str, scanner: Scanner | None = None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all secrets, by start and then as KINDS are listed; code points, end exclusive."""
    scanner = scanner or Scanner()
    low = text.lower()
    base = []
    if any(k in low for k in ("passw", "secret", "token", "api")) or not text.isascii():
        base += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    starts, ends = [], []  # of the unions of base spans
    for s, _, e in sorted(base):
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    covered = lambda s, e: (k := bisect.bisect_right(starts, s)) > 0 and ends[k - 1] >= e
    more = [(s, "entropy", e) for s, e in entropy_spans(text, scanner) if not covered(s, e)]
    return sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1])))


def redact(text: str, spans: list[tuple[int, str, int]], mark: str = "[secret]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def finder(p: SecretParams = SecretParams()):
    """A function from a column of UTF-8 texts to struct(spans, redacted); the redacted text of null is null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(p)
        for raws in batches:
            spans, texts = [], []
            for raw in raws:
                t = "" if raw is None else raw.decode("utf-8", "replace")
                found = find_spans(t, scanner)
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                texts.append(None if raw is None else redact(t, found) if found else t)
            yield pd.DataFrame({"spans": spans, "redacted": texts})

    return F.pandas_udf(run, "spans array<struct<start:long,kind:string,`end`:long>>, redacted string")


def redacted(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """``docs`` (all columns) with secrets in ``text`` replaced, and ``n_chars`` (where there is one) counted anew for those."""
    name = free_name(docs, "found")
    found = docs.withColumn(name, finder(p)(utf8("text")))
    hit = F.size(f"{name}.spans") > 0
    found = found.withColumn("text", F.when(hit, F.col(f"{name}.redacted")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def digest(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """The scan as counts and digests: doc_id, n_assign, n_access, n_hex, base_sha256, spans; then n_entropy."""
    found = docs.select("doc_id", finder(p)(utf8("text")).alias("f")).select("doc_id", F.col("f.spans").alias("spans"))
    show = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "entropy"), show), ",")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", show), ",").alias("spans"), n("entropy").alias("n_entropy"),
    )
