"""Secret scan: fixed patterns and sliding-window Shannon entropy.

The base kinds are matched leftmost and non-overlapping per kind over the whole text. The entropy kinds look at maximal
runs of one character class (hex digits, upper-case letters with digits, base64 letters), slide a window along each run and
keep the sum of c*log2(c) over its character counts up to date as one character enters and one leaves. Windows at or
above the class's threshold are joined to spans (a run shorter than the window, 20 characters, has none); a span is dropped if the whole run matches the allow-list (plain words,
numbers, one repeated character, UUIDs, word paths, documented sample keys). Base spans are never suppressed.

Texts are scanned in Arrow batches, without a shuffle. Positions are code points, ends exclusive.

Defined cases: null counts as empty text, which has no spans and the hash of an empty string; rows that share an id are
separate rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import table

#: The base patterns of the contract, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the same as runs of any length of which shorter ones are dropped
LEAST_ASSIGN, LEAST_ACCESS = 12, 18

WINDOW = 20
#: kind, runs, least bits a character over a window of 20 (random text of each class: about 3.4, 3.9 and 4.1)
CLASSES = (
    ("entropy_hex", re.compile(r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])"), 3.0),
    ("entropy_upper", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{20,}(?![A-Za-z0-9])"), 3.4),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.7),
)
ALLOW = (
    re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+"),
    re.compile(r"[0-9]+"),
    re.compile(r"(.)\1*"),
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"(?:(?:[A-Za-z][a-z]*)?[/_=+-])*(?:[A-Za-z][a-z]*)?"),  # one way to match only, so the time is linear
    re.compile(r"AKIA[A-Z0-9]*EXAMPLE"),
)
KINDS = ("assign", "access", "hex", *(c[0] for c in CLASSES))


def hot_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of the windows whose entropy is ``least`` or more, overlapping ones joined."""
    log, counts, total = [0.0, *(c * math.log2(c) for c in range(1, window + 2))], {}, 0.0
    out: list[tuple[int, int]] = []
    for end, ch in enumerate(run, 1):
        c = counts.get(ch, 0)
        counts[ch], total = c + 1, total + log[c + 1] - log[c]
        if end > window:
            old = run[end - window - 1]
            c = counts[old]
            counts[old], total = c - 1, total + log[c - 1] - log[c]
        if end >= window and math.log2(window) - total / window >= least - 1e-9:
            if out and out[-1][1] >= end - window:
                out[-1] = out[-1][0], end
            else:
                out.append((end - window, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def entropy_spans(text: str, classes=CLASSES, allow=ALLOW) -> list[tuple[int, int, str]]:
    out = []
    for kind, runs, least in classes:
        for m in runs.finditer(text):
            if not any(a.fullmatch(m[0]) for a in allow):
                out += [(m.start() + a, m.start() + b, kind) for a, b in hot_windows(m[0], least)]
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row a document."""

    def run(batches):
        for batch in batches:
            counts, hashes, spans = {k: [] for k in KINDS[:3]}, [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                for k, own in counts.items():
                    own.append(sum(s[2] == k for s in base))
                hashes.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + entropy_spans(text)))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(hashes, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
